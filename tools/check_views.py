"""Check every Spark adapter view against its DuckDB twin."""
import sys, time
sys.path.insert(0, "/root/repo")
from crawlgrid import get_spark
from crawlgrid.sources.adapters import DriverTables
from crawlgrid.plans.oracle_views import with_views
from crawlgrid.plans.compare import compare, duck_connect

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2:]
spark = get_spark("local[8]", shuffle_partitions=8)
t = DriverTables(spark, sf)
con = duck_connect(sf)
names = ["users", "user_keys", "projects", "spiders", "settings", "parameters", "triggers", "queue",
         "history", "items", "log_text", "logs", "nodes", "node_keys", "sessions", "beats", "logins",
         "reports", "completions", "packages", "webhook_jobs", "webhook_events", "requests", "figures", "forms", "plugin_descriptors", "plugin_values", "setting_ops"]
for n in names:
    if only and n not in only:
        continue
    t0 = time.time()
    try:
        r = compare(getattr(t, n), con, with_views(f"SELECT * FROM v_{n}"))
    except Exception as e:
        r = {"match": False, "error": str(e)[:400]}
    print(n, "OK" if r.get("match") else "MISMATCH", round(time.time() - t0, 1), {k: v for k, v in r.items() if k != "match"})
