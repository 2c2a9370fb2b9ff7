"""Plain identifiers that stand in a trusted context, with marks around them, with blanks, or side by side."""

import random

import pytest

from multifactor.llm import pii

_SEEDS = [f"please dial +1 555 010 {i:04d} now" for i in range(2000, 2060)]
_CARDS = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881"]


@pytest.fixture(scope="module")
def found(spark):
    texts = [*_SEEDS, *[f"paid with {c} today" for c in _CARDS * 12], *[f"then x{i} dial +1 555 777 {i:04d} now" for i in range(2000, 2010)]]
    planted = {
        "please dial 555-010-9999, now": ["phone:555-010-9999"],
        'please dial "5550109999" now': ["phone:5550109999"],
        "please dial (555-010-8888) now": ["phone:555-010-8888"],
        "please dial 555 010 7777 now": ["phone:555 010 7777"],
        "please dial (555) 010 6666, now": ["phone:(555) 010 6666"],
        "paid with 4111 1111 1111 1112 today": ["card:4111 1111 1111 1112"],
        "go 7x dial 5550104444 now": ["phone:5550104444"],
        "unknown 555-010-3333, here": [],
    }
    docs = spark.createDataFrame(list(enumerate([*texts, *planted])), "doc_id long, text string")
    rows = {r.key: r.discovered for r in pii.personal_data(docs).collect()}
    got = {}
    for i, text in enumerate(planted):
        spans = rows[len(texts) + i]
        assert all(text[s.start : s.stop] == s.value for s in spans)
        got[text] = [f"{pii.KINDS[s.kind]}:{s.value}" for s in spans]
    return got, planted


def test_planted_identifiers_are_discovered(found):
    got, planted = found
    assert got == planted


def test_context_is_taken_from_neighbouring_identifiers(spark):
    docs = spark.createDataFrame([(1, "a1 b2 c3")], "doc_id long, text string")
    words = pii.base_entities(docs).first().tokens
    assert [(w.value, w.before, w.behind) for w in words] == [("a1", "", "b2"), ("b2", "a1", "c3"), ("c3", "b2", "")]


def test_secrets_are_discovered_by_context_and_forms_alone_are_not(spark):
    rng = random.Random(2)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    luhn = ["4111111111111111", "5500000000000004", "4012888888881881", "4222222222222220", "4000000000000002", "5105105105105100"]
    texts = [f'word{i} then token = "{key(40)}" rest' for i in range(12)] + [f"{a} {c} {b}" for a, b, c in zip("abcdef", "ghijkl", luhn, strict=True)]
    planted = {
        'a token = "correcthorse" b': ["secret:correcthorse"],
        "x token = short9key9 y": ["secret:short9key9"],
        'TOKEN = "AB12CD34EF56AB12CD34EF56"!!': ["secret:AB12CD34EF56AB12CD34EF56"],
        f'config token="{(k := key(40))}", done': [f"secret:{k}"],
        "commit 0123456789abcdef0123456789abcdef01234567 done": [],
        "p 4111111111111112 q": [],
        "p 411111111111111 q": [],
        "version 3.0 of 2024-01-01": [],
    }
    docs = spark.createDataFrame(list(enumerate([*texts, *planted])), "doc_id long, text string")
    rows = {r.key: r.discovered for r in pii.personal_data(docs).collect()}
    assert all([(s.kind, t[s.start : s.stop]) for s in rows[i]] == [(4, t.split('"')[1])] for i, t in enumerate(texts[:12]))
    for i, (text, want) in enumerate(planted.items(), len(texts)):
        assert [f"{pii.KINDS[s.kind]}:{s.value}" for s in rows[i]] == want, text
        assert all(text[s.start : s.stop] == s.value for s in rows[i])


def _discovered(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.key: [(pii.KINDS[s.kind], s.value) for s in r.discovered] for r in pii.personal_data(docs, **options).collect()}


def test_what_a_round_finds_makes_new_patterns_count(spark):
    """Forty numbers are known by their context; the same stand in a second context, and only there stand forty others."""
    seeds = [f"w{i} x call +1 555 010 {i:04d} now" for i in range(1000, 1060)]
    both = [f"555 777 {i:04d}" for i in range(2000, 2040)]
    beyond = [f"555 888 {i:04d}" for i in range(3000, 3040)]
    texts = [*seeds, *[f"q{i} x call {v} now" for i, v in enumerate(both)], *[f"r{i} y ring {v} then" for i, v in enumerate(both)], *[f"s{i} y ring {v} then" for i, v in enumerate(beyond)]]
    for rounds, found in ((1, 0), (3, 40)):
        got = _discovered(spark, texts, rounds=rounds)
        assert sum(("phone", v) in got[60 + i] for i, v in enumerate(both)) == 40
        assert sum(("phone", v) in got[140 + i] for i, v in enumerate(beyond)) == found


def test_numbers_that_fail_the_check_speak_against_their_context(spark):
    """Of 200 order numbers of 16 digits about a tenth pass by chance: none of the others becomes a card."""
    rng = random.Random(9)
    texts = [f"the order {rng.randrange(10**15, 10**16)} was sent" for _ in range(200)]
    got = _discovered(spark, texts)
    assert not any(got.values())


def test_half_of_the_assigned_secrets_is_found_by_context_alone(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    got = _discovered(spark, [f'w{i} api_token = "{v}" end' for i, v in enumerate(values)])
    assert all(got[i] == [("secret", v)] for i, v in enumerate(values))
    got = _discovered(spark, [f'w{i} api_token = "{v}" end' for i, v in enumerate(values)], rounds=1, support=1000)
    assert 15 < sum(map(bool, got.values())) < 45  # the seeds alone
