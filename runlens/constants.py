"""Values the operators share."""

# Job states, the sets built from them, and the listing rank of each state.
QUEUED = "QUEUED"
PROFILING = "PROFILING"
RUNNING = "RUNNING"
SUCCEEDED = "SUCCEEDED"
FAILED = "FAILED"
PREEMPTED = "PREEMPTED"
STOPPABLE = (QUEUED, PROFILING, RUNNING)
RESUMABLE = (PREEMPTED, FAILED)
RUNNABLE = (QUEUED, RUNNING)
ACTIVE = (RUNNING, PROFILING)
STATUS_RANK = {PROFILING: 0, RUNNING: 1, QUEUED: 2, PREEMPTED: 3, FAILED: 4, SUCCEEDED: 5}
OTHER_STATUS_RANK = 9

# Defaults and limits of a submission.
DEFAULT_PRIORITY = 3
PRIORITY_MIN, PRIORITY_MAX = 1, 5
DEFAULT_EPOCHS_TOTAL = 20
DEFAULT_PROFILING_EPOCHS = 3
DEFAULT_JOB_TYPE = "unknown"
BROKEN_SUBMISSION = "not a JSON object"
PROFILING_CONFIGS_PER_JOB = 1

# Patterns and sizes.
IMAGE_PATTERN = r"^[a-zA-Z0-9][a-zA-Z0-9._/:@-]*$"
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PROGRESS_PATTERN = r"Epoch\s+(\d+/\d+)"
EPOCH_LINE_PATTERN = r"Epoch (\d+/\d+ - Loss: (?:[0-9.eE+-]+|nan|inf) - Acc: [0-9.]+% - [0-9.]+)s"
LINE_TIME_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
ATTEMPT_PATTERN = r"Starting training from epoch (\d+) to (\d+)"
SHORT_ID_LENGTH = 8
MAX_LOG_BYTES = 5 * 1024 * 1024
JOB_TIMEOUT_SECONDS = 24 * 3600
LOG_FILE_NAME = "output.log"
PAGE_SIZE, PAGE_SIZE_MAX, TABLE_PAGE_SIZE = 100, 500, 15
MISSING = "—"

# Thread settings a worker adds to the environment of a run.
WORKER_THREAD_ENV = {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "MKL_NUM_THREADS": "1"}

# A deployment names its own container prefix; this neutral one is only the default.
CONTAINER_PREFIX = "run-"
