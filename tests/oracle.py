"""Run a query in Spark and its SQL in DuckDB and compare rows (columns by name, rows in any order)."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


#: Queries that SQL cannot express, and the tests that hold them against brute force, a library or held-out accuracy.
TESTED = {
    "pca_variance": "tests/test_scale.py", "probe_logistic": "tests/test_scale.py", "probe_svm": "tests/test_probes.py", "probe_evaluation": "tests/test_probes.py", "approximate_neighbours": "tests/test_probes.py",
    "op2_best_fit_packing": "tests/llm/test_packing.py", "op3_quality": "tests/llm/test_classifiers.py", "op5_ppm_scores": "tests/llm/test_ppm.py", "op6_one_bit_neighbours": "tests/llm/test_vectors.py",
    "op8_toxicity": "tests/llm/test_classifiers.py", "op10_sentencepiece_fst": "tests/llm/test_piece_fst.py", "op13_bpe_transducer": "tests/llm/test_bpe_lexicon.py", "pipeline": "tests/llm/test_pipeline.py",
}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_norm(x) for x in v)
    if hasattr(v, "as_integer_ratio"):
        return float(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def same(a, b, tol=2e-6):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y, tol) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= tol * max(1.0, abs(a))
    return a == b


def compare(spark, con, fn, sql, sf_dir, name: str = "") -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    cols, rows = rows_of(df.columns, df.collect())
    if sql is None:
        if name not in TESTED:
            return False, "neither SQL nor a test is named for this query"
        return len(rows) > 0, f"{len(rows)} rows, values in {TESTED[name]}"
    cur = con.execute(sql)
    dcols, drows = rows_of([c[0] for c in cur.description], cur.fetchall())
    if cols != dcols:
        return False, f"columns differ: only spark {set(cols) - set(dcols)}, only sql {set(dcols) - set(cols)}"
    if len(rows) != len(drows):
        return False, f"row counts differ: {len(rows)} vs {len(drows)}"
    exact = sum(a == b for a, b in zip(rows, drows))
    bad = [(a, b) for a, b in zip(rows, drows) if not same(a, b)]
    if bad:
        return False, f"{len(bad)} of {len(rows)} rows differ on {cols}: {bad[0]}"
    note = "" if exact == len(rows) else f" ({len(rows) - exact} equal only within tolerance)"
    return len(rows) > 0, f"{len(rows)} rows{note}"


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from gridloom.session import local_session

    sf = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf, argv = argv[0], argv[1:]
    spark, con = local_session(8), duck(sf)
    qs, os_ = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in qs.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, fn, os_.get(name), sf, name)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {note[:1200]}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
