"""python -m tests.check_all [sf_dir] [name ...]: every query against its SQL, with times."""

from __future__ import annotations

import sys
import time
import traceback

import __spark_entry__ as contract
from tarnwork.session import local_session
from tests import oracle


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session(8)
    con = oracle.connection(sf_dir)
    sqls, failed = contract.oracle_sql(), 0
    for name, build in contract.queries().items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            df = build(spark, sf_dir)
            got = oracle.spark_rows(df)
            took = time.time() - begin
            if name not in sqls:
                print(f"rows  {name} {sum(got[1].values())} {took:.1f}s", flush=True)
                continue
            problem = oracle.difference(got, oracle.sql_rows(con, sqls[name]))
            types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            sql_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sqls[name]}").fetchall()}
            odd = {
                c: (t, sql_types.get(c)) for c, t in types.items()
                if oracle.type_family(t) != oracle.type_family(sql_types.get(c, ""))
            }
            if odd:
                problem = f"{problem or ''} types {odd}"
            failed += problem is not None
            print(f"{'FAIL ' if problem else 'ok   '} {name} {sum(got[1].values())} {took:.1f}s {problem or ''}"[:1500], flush=True)
        except Exception as error:
            failed += 1
            text = "".join(traceback.format_exception_only(error))[:900]
            print(f"ERROR {name} {text}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) else 0)
