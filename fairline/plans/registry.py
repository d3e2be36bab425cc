"""Every query of the odds library by name, with the SQL that must give the same rows."""

from fairline.plans import boards, desk, grading, history, learned, markets, study, value

MODULES = (value, history, grading, desk, markets, study, boards, learned)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
