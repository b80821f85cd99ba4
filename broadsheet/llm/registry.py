"""The corpus queries by name; each module brings its own query and, where there is one, its SQL."""

from . import fingerprints, mixing, packing, pages, pii, quality, simhash, substrings, tokenids, toxicity

MODULES = (mixing, simhash, substrings, packing, toxicity, tokenids, fingerprints, pages, quality, pii)


def queries():
    return {m.NAME: m.query for m in MODULES}


def oracle_sql():
    return {m.NAME: m.SQL for m in MODULES if m.SQL}
