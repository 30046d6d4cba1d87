"""Fixed values that must equal the crawl server's for right results.

They are listed plainly and together; operators take them as defaults.
"""

# --- fixed values: job status codes -------------------------------------
PENDING = 0
RUNNING = 1
SUCCESS = 2
FAIL = 3
WARNING = 4
STOPPING = 5
CANCEL = 6

# --- fixed values: job_status table (code 6 has no row) ------------------
JOB_STATUS_ROWS = [
    (0, "pending", "job is not started"),
    (1, "running", "job is running"),
    (2, "success", "job is finished successfully"),
    (3, "fail", "job is finished with error"),
    (4, "warning", "job is finished with error or warning log"),
    (5, "stopping", "job is finished with error or warning log"),
]

# --- fixed values: operating constants (seconds / counts) ----------------
DEFAULT_JOB_TIMEOUT = 3600
UPDATE_GRACE = 60
KILL_GRACE = 120
NODE_TIMEOUT = 60
SESSION_GUARD = 60
HISTORY_KEEP = 100
RUNNING_LIMIT = 1
RECENT_FINISHED = 100
KEY_QUOTA = 10
NODE_KEY_LIFETIME = 3600
WEBHOOK_MEMORY_LIMIT = 4096000

# --- fixed values: settings defaults when a key is missing ---------------
SETTING_DEFAULTS = {"concurrency": "1", "timeout": "3600", "tag": ""}

# --- fixed values: setting value patterns (others: '.*') ----------------
SETTING_PATTERNS = {
    "concurrency": r"\d+",
    "timeout": r"\d+",
    "webhook_batch_size": r"\d+",
}
KNOWN_SETTING_KEYS = [
    "concurrency", "timeout", "tag", "extra_requirements",
    "webhook_payload", "webhook_batch_size",
]

# --- fixed values: log statistic patterns (trailing comma required) -----
ITEMS_PATTERN = r"'item_scraped_count': (\d+),"
ERROR_PATTERN = r"'log_count/ERROR': (\d+),"
WARNING_PATTERN = r"'log_count/WARNING': (\d+),"

# --- fixed values: snowflake id layout ----------------------------------
SNOWFLAKE_EPOCH_MS = 1142974214000
SNOWFLAKE_SEQUENCE_BITS = 12
SNOWFLAKE_WORKER_BITS = 5
SNOWFLAKE_DATACENTER_BITS = 5

# --- fixed values: truthy words of the settings parser ------------------
TRUE_WORDS = ["yes", "true", "t", "1", "on"]

# --- fixed values: failed-job mail --------------------------------------
# the server puts its own product name before " job failed"; ours is a parameter
FAIL_MAIL_SUBJECT = "crawl job failed"
FAIL_MAIL_BODY = "bot:%s \r\nspider:%s \r\n job_id:%s \r\n"

# --- fixed values: storage layouts --------------------------------------
V1_LOG_PATH = "logs/%s/%s/%s.log"          # project name, spider, job id
V1_ITEMS_PATH = "items/%s/%s/%s.jl"
V1_PACKAGE_PATH = "eggs/%s/%s.egg"         # project name, version
V2_LOG_PATH = "projects/%s/spiders/%s/jobs/%s/job.log"   # project id
V2_ITEMS_PATH = "projects/%s/spiders/%s/jobs/%s/items.jl"
V2_PACKAGE_PATH = "projects/%s/eggs/%s.egg"

# --- fixed values: cron field ranges (min, max) -------------------------
CRON_FIELDS = ["minute", "hour", "day", "month", "day_of_week"]
CRON_RANGES = {
    "minute": (0, 59),
    "hour": (0, 23),
    "day": (1, 31),
    "month": (1, 12),
    "day_of_week": (0, 6),
}
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun",
               "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAY_NAMES = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

# --- fixed values: webhook batch error ----------------------------------
BAD_ITEMS_LOG = "Error when decoding jl file"
MEMORY_LIMIT_LOG = "Webhook task memory usage over %s, \n"
