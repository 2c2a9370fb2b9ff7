"""Operators on one table: profile, preparation, adequacy, factor methods, description and clustering."""
