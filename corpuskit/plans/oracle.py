"""For each query that SQL can express, the SQL it is checked against."""

from corpuskit.plans import advanced, features, relational, retrieval, styles, text, vectors

ORACLE: dict[str, str] = {**advanced.ORACLE, **features.ORACLE, **relational.ORACLE, **retrieval.ORACLE, **styles.ORACLE, **text.ORACLE, **vectors.ORACLE}
