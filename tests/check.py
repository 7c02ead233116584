"""Developer tool: compare all or named queries with their SQL twins. Usage: check.py SF [name ...]"""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

import coppice.plans.catalog as catalog  # noqa: E402
from coppice.session import build_session  # noqa: E402
from harness import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "10g",
                                                    "spark.ui.showConsoleProgress": "false"})
    con = connect(sf_dir)
    bad = 0
    for name, fn in catalog.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            sql = catalog.oracle_sql().get(name)
            if sql is None:
                n, problems = len(fn(spark, sf_dir).collect()), []
            else:
                n, problems = compare(spark, con, fn, sql, sf_dir)
        except Exception as error:  # report and go on
            n, problems = -1, [str(error)[:900]]
        bad += bool(problems) or n == 0
        print(f"{'OK ' if not problems and n else 'BAD'} {name} rows={n} {time.time() - start:.1f}s"
              f"{'' if sql else ' (rows only)'}", *[p[:1500] for p in problems], flush=True)
    print("failures:", bad)
