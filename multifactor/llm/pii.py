"""Personal data by bootstrapped contextual extraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.llm.common import quoted, row_hash, stored

#: The four kinds of base spans, and what only the method finds: secrets (keys, tokens, passwords) that a text assigns.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

# A run is entered at its start or where the match before ended, so that a long run is read once; matches stay the same.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Single separators between digits are first replaced by \x01, which keeps positions; so no repeated group is needed.
_CARD = r"[0-9][0-9\x01]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words with a digit or an at sign may be identifiers.
_TOKEN = r"(?:(?<![^\x20\x09-\x0D])|\G)[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Words of digits that single blanks join, with the marks around them; so many of them as the longest card has digits.
_RUN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9A-Za-z@]*+[0-9][0-9().-]*+(?:\x20[0-9(][0-9().-]*+){1,18}[^\x20\x09-\x0D0-9A-Za-z]*+(?![^\x20\x09-\x0D])"
#: Words in quotes that follow a sign of assignment, without digits (those with digits are words of _TOKEN).
_QUOTED = r"(?<=[=:]\x20?[\"'])[^\x20\x09-\x0D\"'0-9@]{8,64}+(?=[\"'])"
_ANY_QUOTED = r"[=:]\x20?[\"']"
#: A name and the sign of assignment at the beginning of a word, such as key=...
_NAMED = r"^[\"'(]*([A-Za-z_][A-Za-z0-9_.-]*+)=[\"']*"
#: What stands before an assigned value, and what is so long and mixed that an assignment makes it a seed of secrets.
_ASSIGNED, _SEED_SECRET = r"[=:]>?$", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]{20,}$"
#: Marks around a candidate that are not part of it.
_OPEN, _CLOSE = r"^(?:[^0-9A-Za-z+:(@]|[(](?![^)]*[)].*[0-9]))++", r"(?:(?<!:):(?!:))?[^0-9A-Za-z:]*$"
_LAST_WORDS, _FIRST_WORD = r"((?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)"
_QUOTES = "\"'("
_BLANKS = r"[\x20\x09-\x0D]+"
#: Matches of one text that are gathered before they join the list of all.
CHUNK = 256
_FOUND = "array<struct<start:bigint,stop:bigint,value:string,before:string,behind:string>>"

#: What a candidate must look like to be taken for a kind, once its context speaks for it.
_SHAPES = {"email": r"[^@]@[^@]", "ip": r"^[0-9A-Fa-f]+([.:][0-9A-Fa-f]*){3,}$", "card": r"^[0-9][0-9\x20-]{10,}[0-9]$", "phone": r"^\+?[0-9()][0-9().\x20-]{5,18}[0-9]$", "secret": r"^(?=.*[A-Za-z])[A-Za-z0-9+/=_.~!#$%^&*-]{8,}$"}
#: What looks like a kind and fails its check: dotted quads that are no address, 12 to 19 digits without a check digit that fits.
_FALSE_IP = r"^[0-9]+(?:\.[0-9]+){3}$"
#: How much an occurrence of an unknown candidate speaks against a pattern, beside 1 for a look-alike or another kind's.
UNKNOWN = 0.25


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(text: str, pattern: str, when: str) -> Column:
    """Matches of a pattern where ``when`` holds: (start, stop, value, before, behind), positions in code points.

    The pieces between the matches give positions; with the matches beside them, they give the two words before each
    match and the word behind it (at most 64 characters of them). The walk goes chunk by chunk, so that no growing list
    is copied at every match of a very long text.
    """
    pieces = f"split({text}, {_q(pattern)}, -1)"
    matches = f"regexp_extract_all({text}, {_q(pattern)}, 0)"
    pairs = f"zip_with({matches}, {pieces}, (m, p) -> named_struct('m', m, 'p', p))"
    pairs = f"zip_with({pairs}, slice(concat(array(''), {matches}), 1, size({pieces})), (x, w) -> named_struct('m', x.m, 'p', x.p, 'b', concat(right(w, 256), x.p)))"
    behind = f"zip_with(slice({pieces}, 2, {1 << 30}), slice({matches}, 2, {1 << 30}), (q, w) -> concat(left(q, 256), if(length(q) < 256, left(coalesce(w, ''), 256), '')))"
    zipped = f"zip_with({pairs}, {behind}, (x, q) -> named_struct('m', x.m, 'p', x.p, 'b', x.b, 'q', q))"
    one = f"""named_struct('start', a.at + length(x.p), 'stop', a.at + length(x.p) + length(x.m), 'value', x.m,
        'before', lower(right(regexp_replace(regexp_extract(rtrim({_q(_QUOTES)}, right(x.b, 256)), {_q(_LAST_WORDS)}, 1), {_q(_BLANKS)}, ' '), 64)), 'behind', lower(left(regexp_extract(left(x.q, 256), {_q(_FIRST_WORD)}, 1), 64)))"""
    chunk = f"""aggregate(slice(z, k + 1, {CHUNK}), named_struct('at', b.at, 'found', cast(array() as {_FOUND})), (a, x) -> named_struct(
        'at', a.at + length(x.p) + coalesce(length(x.m), 0), 'found', if(x.m is null, a.found, concat(a.found, array({one})))))"""
    walked = f"""flatten(aggregate(sequence(0, size(z) - 1, {CHUNK}), named_struct('at', 0L, 'found', cast(array() as array<{_FOUND}>)),
        (b, k) -> element_at(transform(array({chunk}), c -> named_struct('at', c.at, 'found', concat(b.found, array(c.found)))), 1)).found)"""
    return F.expr(f"if({when}, element_at(transform(array({zipped}), z -> {walked}), 1), cast(array() as {_FOUND}))")


def _luhn(digits: str) -> str:
    """SQL that tells if the check digit of a string of digits fits."""
    return f"""aggregate(sequence(1, length({digits})), 0, (s, i) -> s + case when i % 2 = 1 then cast(substr({digits}, -i, 1) as int)
        when cast(substr({digits}, -i, 1) as int) > 4 then 2 * cast(substr({digits}, -i, 1) as int) - 9 else 2 * cast(substr({digits}, -i, 1) as int) end) % 10 = 0"""


def _base(text: str) -> Column:
    """All valid base spans of a text in the order of kinds and places: (kind, start, stop, value, before, behind)."""
    digits = "translate(f.value, '\u0001', '')"
    part = "ltrim('0', p)"
    valid = {
        "email": "true",
        "ip": f"forall(split(f.value, '[.]'), p -> length({part}) < 3 or length({part}) = 3 and {part} <= '255')",
        "card": f"length({digits}) between 16 and 19 and {_luhn(digits)}",
        "phone": "length(regexp_replace(f.value, '[^0-9]', '')) between 8 and 15",
    }
    kinds = [f"transform(filter(m_{k}, f -> {valid[k]}), f -> named_struct('kind', {i}, 'start', f.start, 'stop', f.stop, 'value', f.value, 'before', f.before, 'behind', f.behind))" for i, k in enumerate(BASE_KINDS)]
    return F.expr(f"concat({', '.join(kinds)})")


def _bare(found: str) -> Column:
    """``found`` without the marks around each value and a name assigned before it, its positions adjusted."""
    named = f"regexp_extract(f.value, {_q(_NAMED)}, 0)"
    opened = f"regexp_replace(substr(f.value, length({named}) + 1), {_q(_OPEN)}, '')"
    closed = f"regexp_replace({opened}, {_q(_CLOSE)}, '')"
    before = f"if({named} = '', f.before, concat(lower(right(regexp_extract(f.value, {_q(_NAMED)}, 1), 62)), ' ='))"
    return F.expr(f"""transform({found}, f -> named_struct('start', f.stop - length({opened}), 'stop', f.stop - length({opened}) + length({closed}),
        'value', {closed}, 'before', {before}, 'behind', f.behind))""")


def base_entities(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored rows ``nth``, ``key``, ``h``, ``base`` (valid base spans) and ``tokens`` (words with digits or @, runs of digits, quoted values)."""
    t = docs.select(F.monotonically_increasing_id().alias("nth"), F.col(quoted(key)).alias("key"), row_hash(docs, 42).alias("h"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("t"))
    joined = F.when(F.expr(r"t rlike '[0-9](?:[ -]?[0-9]){15}'"), F.regexp_replace(F.translate("t", "\x01", "\x02"), r"(?<=[0-9])[\x20-](?=[0-9])", "\x01")).otherwise(F.lit(""))
    t = t.withColumn("c", joined)
    t = t.select(
        "nth", "key", "h", _located("t", _EMAIL, "contains(t, '@')").alias("m_email"), _located("t", _IP, r"t rlike '[0-9][.][0-9]'").alias("m_ip"),
        _located("c", _CARD, "c != ''").alias("m_card"), _located("t", _PHONE, "contains(t, '+')").alias("m_phone"),
        _located("t", _TOKEN, "t rlike '[0-9@]'").alias("words"),
        _located("t", _RUN, "t rlike '[0-9][^A-Za-z0-9]? [0-9(]'").alias("runs"),
        _located("t", _QUOTED, f"t rlike {_q(_ANY_QUOTED)}").alias("quoted"),
    )
    return stored(t.select("nth", "key", "h", _base("t").alias("base"), _bare("concat(words, runs, quoted)").alias("tokens")))


def candidates(found: DataFrame) -> DataFrame:
    """Stored rows (nth, start, stop, value, before, behind): the words and runs of ``found`` that no base span touches.

    In each text, the largest end of the base spans begun so far and the least start of those still to come decide.
    """
    plain = found.where("size(tokens) > 0 and size(base) = 0").select("nth", F.explode("tokens").alias("w")).select("nth", "w.*")
    mixed = found.where("size(tokens) > 0 and size(base) > 0")
    words = mixed.select("nth", F.explode("tokens").alias("w")).select("nth", "w.*", F.lit(None).cast("long").alias("b_start"), F.lit(None).cast("long").alias("b_stop"))
    spans = mixed.select("nth", F.explode("base").alias("w")).select("nth", "w.start", "w.stop", *[F.lit(None).cast("string").alias(c) for c in ("value", "before", "behind")], F.col("w.start").alias("b_start"), F.col("w.stop").alias("b_stop"))
    begun = W.partitionBy("nth").orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    coming = W.partitionBy("nth").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, -1)
    both = words.unionByName(spans).withColumn("reach", F.max("b_stop").over(begun)).withColumn("next", F.min("b_start").over(coming))
    free = both.where(F.col("value").isNotNull() & ~F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("next") < F.col("stop"), F.lit(False)))
    return stored(plain.unionByName(free.select(*plain.columns)))


def _patterns(rows: DataFrame) -> DataFrame:
    """``rows`` (kind, value, before, behind, seed, false) as pattern-instance edges (kind, side, word, value, seed, false, n).

    Patterns are the word before, the two words before, and the word behind.
    """
    words = {"before": F.substring_index("before", " ", -1), "two before": F.when(F.contains("before", F.lit(" ")), F.col("before")), "behind": F.col("behind")}
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), word.alias("word")) for side, word in words.items()])).alias("p")
    edges = rows.select("kind", "value", "seed", "false", sides).where("p.word is not null and p.word != ''")
    return edges.groupBy("kind", "p.side", "p.word", "value").agg(F.max("seed").alias("seed"), F.max("false").alias("false"), F.count("*").alias("n"))


def _candidate_kinds(words: DataFrame) -> DataFrame:
    """Each candidate with each kind whose shape it has: (kind, value, before, behind, seed, false).

    Seeds of secrets are a half of the assigned values, by a hash of the value; the other half is for the contexts to find.
    ``false`` marks values that look like a kind and fail its check.
    """
    secret = KINDS.index("secret")
    shaped = F.explode(F.filter(F.array(*[F.when(F.col("value").rlike(shape), F.lit(KINDS.index(kind))) for kind, shape in _SHAPES.items()]), lambda k: k.isNotNull()))
    rows = words.select(shaped.alias("kind"), "value", "before", "behind")
    assigned = (F.col("kind") == secret) & F.col("before").rlike(_ASSIGNED) & F.col("value").rlike(_SEED_SECRET)
    digits = "regexp_replace(value, '[^0-9]', '')"
    failed = F.when(F.col("kind") == KINDS.index("ip"), F.col("value").rlike(_FALSE_IP)).when(
        F.col("kind") == KINDS.index("card"), F.expr(f"if(length({digits}) between 12 and 19, not ({_luhn(digits)}), true)")
    ).when(F.col("kind") == KINDS.index("phone"), F.expr(f"length({digits}) not between 5 and 15"))
    return rows.withColumn("seed", assigned & (F.pmod(F.xxhash64(F.lit(7), "value"), F.lit(2)) == 0)).withColumn("false", F.coalesce(failed, F.lit(False)))


def bootstrap(edges: DataFrame, *, rounds: int, confidence: float, support: int, caution: float) -> DataFrame:
    """(value, kind, score) of what patterns find, from stored pattern-instance ``edges``, in rounds that build on one another.

    In each round the trusted values are the seeds and what the rounds before have found. A pattern counts once
    ``support`` different trusted values of its kind stand in it. Its confidence is the score of their occurrences, over
    the same plus the occurrences of values that speak against it (look-alikes that fail the kind's check, and values trusted
    for another kind), plus UNKNOWN times those of unknown ones, plus ``caution``. A candidate's score is the noisy-or of the
    best patterns on its sides; values that reach ``confidence`` are trusted with their best kind from then on.
    """
    patterns = ["kind", "side", "word"]
    # a pattern that too few different values share can never count
    shared = edges.groupBy(*patterns).agg(F.count("*").alias("m")).where(F.col("m") >= support).select(*patterns)
    edges = stored(edges.join(shared, patterns))
    known = None
    for _ in range(rounds):
        if known is None:
            marked = edges.withColumn("trust", F.when(F.col("seed"), 1.0)).withColumn("other", F.lit(False))
        else:
            same = F.col("known_kind") == F.col("kind")
            trust = F.when(F.col("seed"), 1.0).when(same, F.col("score"))
            marked = edges.join(known.select("value", F.col("kind").alias("known_kind"), "score"), "value", "left").withColumn("trust", trust).withColumn("other", F.coalesce(~same, F.lit(False)) & ~F.col("seed"))
        against = F.when(F.col("trust").isNotNull(), 0.0).when(F.col("false") | F.col("other"), 1.0).otherwise(UNKNOWN)
        held = marked.groupBy(*patterns).agg(F.count("trust").alias("m"), F.sum(F.coalesce(F.col("trust"), F.lit(0.0)) * F.col("n")).alias("good"), F.sum(against * F.col("n")).alias("bad"))
        conf = held.where(F.col("m") >= support).select(*patterns, (F.col("good") / (F.col("good") + F.col("bad") + caution)).alias("conf"))
        best = edges.where("not seed").join(conf, patterns).groupBy("kind", "value", "side").agg(F.max("conf").alias("conf"))
        scores = best.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))).alias("score")).where(F.col("score") >= confidence)
        known = stored(scores.groupBy("value").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("k")).select("value", "k.kind", "k.score"))
    return known


def personal_data(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", rounds: int = 3, confidence: float = 0.7, support: int = 3, caution: float = 2.0
) -> DataFrame:
    """One row for each row of ``docs``: ``nth``, ``key``, ``h``, ``base`` and ``discovered`` spans (kind, start, stop, value, ...).

    Base spans are the four expressions' leftmost matches that pass their checks; they are the seeds of their kinds. Seeds
    of secrets are a half, by a hash, of the long words of letters and digits that a sign of assignment precedes. The words
    beside seeds are patterns of their kind. Other words with digits or an at sign, numbers written with blanks, and
    quoted values after a sign of assignment, all without the marks around them, are candidates of the kinds whose shape
    they have, with patterns of their own.

    ``bootstrap`` scores patterns by their instances and instances by their patterns in ``rounds`` rounds: what a round finds
    makes new patterns count in the next. What is found is discovered at every place where it stands; seeds of secrets too.

    Positions are code points, end exclusive; a null text counts as empty; repeated rows each get a row; an empty
    table gives none. Base spans never change; discovered ones do not overlap them.
    """
    found = base_entities(docs, key=key, text=text)
    words = candidates(found)
    secret = KINDS.index("secret")
    seeds = found.select(F.explode("base").alias("w")).select("w.kind", "w.value", "w.before", "w.behind", F.lit(True).alias("seed"), F.lit(False).alias("false"))
    others = _candidate_kinds(words)
    edges = stored(_patterns(seeds.unionByName(others)))
    known = bootstrap(edges, rounds=rounds, confidence=confidence, support=support, caution=caution)
    own = others.where("seed").select("value", F.lit(secret).alias("kind"), F.lit(1.0).alias("score"))
    best = stored(known.unionByName(own).groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")))
    earlier = W.partitionBy("nth").orderBy("start", F.desc("stop")).rowsBetween(W.unboundedPreceding, -1)
    hits = words.join(best, "value").select("nth", "kind", "start", "stop", "value").distinct().withColumn("reach", F.max("stop").over(earlier))
    hits = hits.where(F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)))  # a word inside a run gives way to it
    hits = hits.groupBy("nth").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "stop", "value"))).alias("discovered"))
    none = F.expr("cast(array() as array<struct<kind:int,start:bigint,stop:bigint,value:string>>)")
    return found.join(hits, "nth", "left").select("nth", "key", "h", "base", F.coalesce("discovered", none).alias("discovered"))
