"""Queries by name; each takes the session and the folder of the tables."""

from corpuskit.operators import timestamps
from corpuskit.plans import advanced, features, relational, retrieval, styles, text, vectors

QUERIES = {
    **advanced.QUERIES,
    **features.QUERIES,
    **relational.QUERIES,
    **retrieval.QUERIES,
    **styles.QUERIES,
    **text.QUERIES,
    **vectors.QUERIES,
    "p3_found": timestamps.p3_found,
    "p3_normalised": timestamps.p3_normalised,
}
