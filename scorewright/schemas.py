"""Schemas, as DDL, of the tables that the operators exchange."""

CANDIDATES = "ARRAY<STRUCT<token: STRING, logprob: DOUBLE>>"

ITEMS = "example_id STRING, dataset STRING, split STRING, subset STRING, prompt STRING, ground_truth STRING"

# What a model's answer adds to a prompt; all but the response are optional.
ANSWER = f"response STRING, first_token_logprobs {CANDIDATES}, started_at TIMESTAMP, finished_at TIMESTAMP"
ANSWER_COLUMNS = ("response", "first_token_logprobs", "started_at", "finished_at")

RESPONSES = f"example_id STRING, dataset STRING, split STRING, model STRING, {ANSWER}"
RESPONSE_COLUMNS = ("example_id", "dataset", "split", "model", *ANSWER_COLUMNS)

# Items whose responses are spread over several buckets, and over how many.
HOT_ITEMS = "dataset STRING, split STRING, example_id STRING, salts INT"

RESULTS = (
    "example_id STRING, prompt STRING, model_response STRING, extracted_answer STRING, "
    "ground_truth_answer STRING, ground_truth_reasoning STRING, is_correct BOOLEAN, "
    "metadata STRUCT<dataset: STRING, model: STRING, subset: STRING>, "
    "logprobs MAP<STRING, DOUBLE>, split STRING"
)

METRICS = (
    "model STRING, dataset STRING, split STRING, total_samples LONG, accuracy DOUBLE, "
    "total_time DOUBLE, samples_per_second DOUBLE"
)

# What metrics of a part of a run are kept as.
STATES = (
    "model STRING, dataset STRING, split STRING, total_samples LONG, correct_samples LONG, "
    "first_start TIMESTAMP, last_finish TIMESTAMP"
)

# Stands between a short name and the mark that tells it from equal ones.
NAME_MARK = "@"

# What identifies one benchmark item, and so the key of the items-responses join.
ITEM_KEYS = ("dataset", "split", "example_id")
# What identifies one evaluation run.
RUN_KEYS = ("model", "dataset", "split")
