"""A query of a registry and its SQL over the same Parquet tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, records):
    return sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in records)


def differ(spark, query, sql, sf_dir):
    """None, or the first few rows that one side lacks."""
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, found.fetchall())
    return None if ours == theirs else [x for x in zip(ours, theirs, strict=False) if x[0] != x[1]][:3] or (len(ours), len(theirs))
