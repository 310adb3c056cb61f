"""First-token log-probabilities."""

from pyspark.sql import functions as F

from catalog.inputs import Query, table
from scorewright.functions import logprobs
from scorewright.operators.benchmarks import MMLU
from scorewright.operators.score import score

TRUTH = "case p_partkey % 5 when 0 then 'A' when 1 then 'Yes' when 2 then '(B)' when 3 then 'no' else p_name end"
# Thirty candidates a row: choices, other tokens, and tokens that come twice.
TOKENS = ("A", "B", "Yes", "(B)", "the", "no", "yes", "True", "A", "(Q)")


def candidates(spark, folder):
    tokens = "array(" + ", ".join(f"'{token}'" for token in TOKENS) + ")"
    return table(spark, folder, "part").selectExpr(
        "p_partkey",
        "p_type",
        "p_size",
        f"{TRUTH} as ground_truth",
        f"""transform(sequence(1, 30), k -> named_struct('token', if(k <= 10, element_at({tokens}, k), concat('t', k)),
            'logprob', -cast(1 + (p_partkey * k) % 31 as double) / 4)) as candidates""",
    )


def choice_logprobs(spark, folder):
    rows = candidates(spark, folder)
    found = logprobs.choice_logprobs(F.col("candidates"), logprobs.choices_for(F.col("ground_truth")))
    return rows.select("p_partkey", F.explode(found).alias("token", "logprob"))


def choice_families(spark, folder):
    rows = candidates(spark, folder)
    return rows.select("p_partkey", F.array_join(logprobs.choices_for(F.col("ground_truth")), "|").alias("choices"))


def top_candidates(spark, folder):
    rows = candidates(spark, folder).withColumn("best", logprobs.top_candidates(F.col("candidates")))
    return rows.select("p_partkey", F.posexplode("best")).select("p_partkey", F.col("pos").alias("position"), "col.token", "col.logprob")


def result_logprobs(spark, folder):
    """Through scoring: fixed choices of one benchmark, choices by truth for the other."""
    rows = candidates(spark, folder).selectExpr(
        "cast(p_partkey as string) as example_id",
        f"if(p_size > 25, '{MMLU.name}', 'lukaemon/bbh') as dataset",
        "'test' as split",
        "p_type as subset",
        "p_type as prompt",
        "ground_truth",
        "'m' as model",
        "'A' as response",
        "candidates as first_token_logprobs",
    )
    results = score(
        rows.select("example_id", "dataset", "split", "subset", "prompt", "ground_truth"),
        rows.select("example_id", "dataset", "split", "model", "response", "first_token_logprobs"),
    )
    return results.select("example_id", F.explode("logprobs").alias("token", "logprob"))


_TOKEN_LIST = "[" + ", ".join(f"'{token}'" for token in TOKENS) + "]"
_LONG = f"""(select p_partkey, p_size, ground_truth, k, case when k <= 10 then {_TOKEN_LIST}[k] else 't' || k end as token,
    -cast(1 + (p_partkey * k) % 31 as double) / 4 as logprob
  from (select p_partkey, p_size, {TRUTH} as ground_truth, unnest(generate_series(1, 30)) as k from part))"""
_FAMILY = """case when regexp_full_match(ground_truth, '[(][A-Q][)]')
      then list_transform(string_split('ABCDEFGHIJKLMNOPQ', ''), lambda x: '(' || x || ')')
    when regexp_full_match(ground_truth, '[A-F]') then ['A', 'B', 'C', 'D', 'E', 'F']
    when ground_truth in ('True', 'False') then ['True', 'False']
    when ground_truth in ('Yes', 'No') then ['Yes', 'No']
    when ground_truth in ('yes', 'no') then ['yes', 'no']
    else [ground_truth] end"""
_TOP = f"""(select * from (select *, row_number() over (partition by p_partkey order by logprob desc, token desc) as place from {_LONG})
  where place <= 20)"""

QUERIES = [
    Query("choice_logprobs", ("LGP1", "FLT2"), choice_logprobs,
          f"select p_partkey, token, max_by(logprob, k) as logprob from {_LONG} where list_contains({_FAMILY}, token) group by 1, 2"),
    Query("choice_families", ("LGP2",), choice_families,
          f"select p_partkey, array_to_string({_FAMILY}, '|') as choices from (select p_partkey, {TRUTH} as ground_truth from part)"),
    Query("top_candidates", ("LGP4",), top_candidates,
          f"select p_partkey, cast(place - 1 as integer) as position, token, logprob from {_TOP}"),
    Query("result_logprobs", ("LGP1", "LGP2", "LGP3", "LGP4", "FLT2"), result_logprobs,
          f"""select cast(p_partkey as varchar) as example_id, token, max_by(logprob, place) as logprob from {_TOP}
          where list_contains(case when p_size > 25 then ['A', 'B', 'C', 'D'] else {_FAMILY} end, token) group by 1, 2"""),
]
