"""Compare every registered query with its SQL twin: python tests/check_all.py [folder] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, duck_rows, spark_rows  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from stakelens.session import build_session  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = []
    for name in names:
        t0 = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            got = spark_rows(df)
            t1 = time.time()
            if name not in oracles:
                print(f"rows-only {name}: {len(got)} rows {t1 - t0:.2f}s", flush=True)
                continue
            want = duck_rows(con, oracles[name])
            columns = sorted(d[0] for d in con.execute(f"select * from ({oracles[name]}) limit 0").description)
            same = got == want and sorted(df.columns) == columns
            print(f"{'ok  ' if same else 'DIFF'} {name}: {len(got)}/{len(want)} rows {t1 - t0:.2f}s"
                  f" oracle {time.time() - t1:.2f}s", flush=True)
            if not same:
                bad.append(name)
                print("  ", sorted(df.columns), columns)
                print("   spark only", sorted(set(got) - set(want))[:3])
                print("   other only", sorted(set(want) - set(got))[:3], flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
    print("bad:", bad)
    spark.stop()  # closes the state stores before the JVM goes down
