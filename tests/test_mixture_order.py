"""The order of draws in a mixture: those without a number last, equal numbers by value."""

import duckdb

from rundelta.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def made(tmp_path, lines):
    """One order of one customer, with lines of these numbers and prices."""
    values = ", ".join(f"({'NULL' if n is None else n}::INTEGER, {v}::DOUBLE)" for n, v in lines)
    copy = "copy (select x.* replace ({r}) from (from '{f}/{t}.parquet' limit 1) x{more}) to '{to}/{t}.parquet' (format parquet)"
    for t, r, more in (
        ("customer", "1::BIGINT as c_custkey", ""),
        ("orders", "1::BIGINT as o_orderkey, 1::BIGINT as o_custkey", ""),
        ("lineitem", "1::BIGINT as l_orderkey, n as l_linenumber, 50::DOUBLE as l_quantity, v as l_extendedprice", f", (values {values}) s(n, v)"),
    ):
        duckdb.connect().execute(copy.format(r=r, f=FOLDER, t=t, more=more, to=tmp_path))
    return str(tmp_path)


def test_draws_without_a_number_come_last(spark, tmp_path):
    folder = made(tmp_path, [(None, 1000.0), *[(i, float(i)) for i in range(1, 7)]])
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    theirs = {r[1]: r[2:] for r in con.execute(catalogue.oracle_sql()["stacked_mixture"]).fetchall()}
    ours = {r["model"]: (r["n"], r["total"]) for r in catalogue.queries()["stacked_mixture"](spark, folder).collect()}
    assert ours == theirs == {"a": (5, 15.0), "b": (3, 12.0), "c": (2, 9.0)}


def test_draws_of_the_same_number_go_by_value(spark, tmp_path):
    folder = made(tmp_path, [(1, 9.0), (1, 8.0), (1, 7.0), (1, 6.0), (1, 5.0), (1, 4.0), (1, 3.0)])
    ours = {r["model"]: (r["n"], r["total"]) for r in catalogue.queries()["stacked_mixture"](spark, folder).collect()}
    assert ours == {"a": (5, 25.0), "b": (3, 24.0), "c": (2, 21.0)}
