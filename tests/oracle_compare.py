"""Run named queries in Spark and their oracle SQL in DuckDB; compare row count,
column names and an order-insensitive hash of the values.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def rows_digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    normed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256("\n".join(normed).encode()).hexdigest()
    return [cols[i] for i in order], normed, h


def spark_type(dt) -> str:
    """Spark type in DuckDB's spelling, for the schema comparison."""
    from pyspark.sql import types as T
    simple = [(T.LongType, "BIGINT"), (T.IntegerType, "INTEGER"), (T.StringType, "VARCHAR"),
              (T.BooleanType, "BOOLEAN"), (T.DoubleType, "DOUBLE"), (T.DateType, "DATE"),
              (T.TimestampType, "TIMESTAMP"), (T.TimestampNTZType, "TIMESTAMP"), (T.ShortType, "SMALLINT")]
    for k, v in simple:
        if isinstance(dt, k):
            return v
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    return str(dt)


def duck_connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck_connect(sf_dir)
    results = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(e)[:2000])
            if verbose:
                print(f"{name}: SPARK_ERROR {str(e)[:1500]}")
            continue
        ts = time.time() - t0
        if name not in os_:
            results[name] = ("ROWS_ONLY", len(srows))
            if verbose:
                print(f"{name}: rows-only {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            rel = con.sql(os_[name])
            dcols = list(rel.columns)
            dtypes = dict(zip(dcols, map(str, rel.types)))
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("DUCK_ERROR", str(e)[:2000])
            if verbose:
                print(f"{name}: DUCK_ERROR {str(e)[:1500]}")
            continue
        sc, sn, sh = rows_digest(scols, srows)
        dc, dn, dh = rows_digest(dcols, drows)
        stypes = {f.name: spark_type(f.dataType) for f in sdf.schema.fields}
        type_diff = {c: (stypes.get(c), dtypes.get(c)) for c in set(stypes) | set(dtypes) if stypes.get(c) != dtypes.get(c)}
        ok = sc == dc and len(sn) == len(dn) and sh == dh and not type_diff
        results[name] = ("OK" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            print(f"{name}: {'OK' if ok else 'MISMATCH'} spark={len(srows)} duck={len(drows)} ({ts:.1f}s)")
            if not ok:
                if sc != dc:
                    print("   cols spark", sc, "\n   cols duck ", dc)
                if type_diff:
                    print("   types (spark, duck):", type_diff)
                ss, ds = set(sn), set(dn)
                for r in sorted(ss - ds)[:3]:
                    print("   only spark:", r[:600])
                for r in sorted(ds - ss)[:3]:
                    print("   only duck: ", r[:600])
    return results


if __name__ == "__main__":
    from lorekit.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("oracle-compare")
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "ROWS_ONLY")]
    print("SUMMARY", len(res), "queries,", len(bad), "bad:", bad)
