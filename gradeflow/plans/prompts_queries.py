"""Prompt chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeflow.functions import prompts as pr
from gradeflow.plans.registry import query
from gradeflow.plans.scoring_queries import results
from gradeflow.plans.tables import Tables, with_views
from gradeflow.schemas import PROMPT_CHAIN

_TYPES = (
    "CASE doc_id % 5 WHEN 0 THEN 'binary' WHEN 1 THEN 'multiple_choice' WHEN 2 THEN 'text' WHEN 3 THEN 'count' ELSE 'other' END"
)
_PROMPT = (
    "CASE turn % 4 WHEN 0 THEN 'Is {output1} right? And {output2}?' WHEN 1 THEN '{output3} after {output1}, {output1}'"
    " WHEN 2 THEN text ELSE 'Step {{output2}} then {output10} of {output}' END"
)


@query(f"""
SELECT conv_id, turn, array_to_string(list_sort(list_transform(regexp_extract_all(prompt, '\\{{output([0-9]+)\\}}', 1), lambda x: CAST(x AS INTEGER))), ',') AS refs
FROM (SELECT conv_id, turn, {_PROMPT} AS prompt FROM conversations) AS p""")
def prompt_refs(t: Tables) -> DataFrame:
    """Steps a prompt refers to."""
    rows = t.given("conversations").selectExpr("conv_id", "turn", f"{_PROMPT} AS prompt")
    return rows.select("conv_id", "turn", F.array_join(pr.references("prompt").cast("array<string>"), ",").alias("refs"))


@query(f"""
WITH p AS (SELECT conv_id, turn, text, {_PROMPT} AS prompt FROM conversations),
one AS (SELECT *, replace(replace(prompt, '{{{{output1}}}}', 'yes {{output2}}'), '{{output1}}', 'yes {{output2}}') AS s1 FROM p),
two AS (SELECT *, replace(replace(s1, '{{{{output2}}}}', text), '{{output2}}', text) AS s2 FROM one)
SELECT conv_id, turn, md5(s2) AS prompt FROM two""")
def prompt_substitute(t: Tables) -> DataFrame:
    """Outputs put into prompts; an output that refers to the next one is filled too."""
    rows = t.given("conversations").selectExpr("conv_id", "turn", "text", f"{_PROMPT} AS prompt")
    outputs = [(1, F.lit("yes {output2}")), (2, F.col("text")), (3, F.lit(None).cast("string"))]
    return rows.select("conv_id", "turn", F.md5(pr.substitute("prompt", outputs)).alias("prompt"))


@query(f"""
SELECT conv_id, turn, CASE WHEN bad IS NULL THEN NULL WHEN bad >= step THEN 'Cannot reference {{output' || bad || '}} from step ' || step
    ELSE 'Variable {{output' || bad || '}} not available (step may have failed)' END AS error
FROM (SELECT conv_id, turn, turn + 1 AS step,
        list_min(list_filter(list_transform(regexp_extract_all({_PROMPT}, '\\{{output([0-9]+)\\}}', 1), lambda x: CAST(x AS INTEGER)),
                             lambda r: r >= turn + 1 OR r NOT IN (1, 3))) AS bad FROM conversations) AS p""")
def prompt_ref_errors(t: Tables) -> DataFrame:
    """First reference that cannot be filled, where steps 1 and 3 gave an output."""
    rows = t.given("conversations").selectExpr("conv_id", "turn", f"{_PROMPT} AS prompt")
    available = F.array(F.lit(1), F.lit(3))
    return rows.select("conv_id", "turn", pr.reference_error("prompt", F.col("turn") + 1, available).alias("error"))


@query("""
WITH c AS (SELECT conv_id, count(*) FILTER (role <> 'system') AS n, min(turn) FILTER (role <> 'system') AS first_turn,
                  list(turn ORDER BY turn) FILTER (role <> 'system') AS turns FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN n > 5 OR n < 1 THEN 'Prompt chain must have 1-5 steps'
  WHEN first_turn <> 0 THEN 'Step 1 has incorrect step_number: expected 1, got ' || (first_turn + 1) END AS error
FROM c""")
def chain_validate(t: Tables) -> DataFrame:
    """Chains made of the turns of a conversation; one that starts with a system turn is numbered wrong."""
    steps = t.given("conversations").filter(F.col("role") != "system")
    step = F.struct(
        (F.col("turn") + 1).cast("int").alias("step_number"), F.lit(None).cast("string").alias("system_message"),
        F.col("text").alias("prompt"),
    )
    # All steps are counted; only chains that may be valid, of at most MAX_STEPS, are gathered.
    counts = steps.groupBy("conv_id").agg(F.count("*").alias("n"))
    short = steps.join(counts.where(F.col("n") <= pr.MAX_STEPS), "conv_id", "left_semi")
    chains = short.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).cast(PROMPT_CHAIN).alias("chain"))
    everyone = t.given("conversations").select("conv_id").distinct()
    # Without a chain there are no steps or too many, which is one error.
    empty = F.array().cast(PROMPT_CHAIN)
    return everyone.join(chains, "conv_id", "left").select(
        "conv_id", pr.chain_error(F.coalesce("chain", empty)).alias("error")
    )


@query(f"""
SELECT doc_id, CASE {_TYPES}
  WHEN 'binary' THEN 'Reply only true or false, nothing else, only true or false depending on your judgement.'
  WHEN 'multiple_choice' THEN 'Reply only with one of these values: ' || lang || ', ' || source || chr(10) || 'Nothing else, just the exact value from the list above.'
  WHEN 'text' THEN 'Reply as short as you can with classification of what you see.' || chr(10) || 'Do not go longer than absolutely necessary.' || chr(10) || 'Distil to as short and precise label as possible in reply to question.'
  WHEN 'count' THEN 'Reply only with a number that is a count.' || chr(10) || 'Only return the number, nothing else.' || chr(10) || 'Do not show calculation details in the final output (keep it in thinking).' || chr(10) || 'Only return a number.'
  ELSE 'Answer the question based on the image.' END AS prompt FROM documents""")
def system_prompts(t: Tables) -> DataFrame:
    """System prompt by question type."""
    rows = t.given("documents").selectExpr("doc_id", "lang", "source", f"{_TYPES} AS question_type")
    return rows.select("doc_id", pr.system_prompt(F.col("question_type"), F.array("lang", "source")).alias("prompt"))


@query("""
SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 2 ELSE 1 END AS steps,
  CASE WHEN n_chars % 3 = 0 THEN 'first' WHEN n_chars % 3 = 1 THEN lang ELSE 'Reply only true or false, nothing else, only true or false depending on your judgement.' END AS system_message,
  CASE WHEN n_chars % 3 = 0 THEN 'Look at {output1}' WHEN n_chars % 2 = 0 THEN 'Is it ' || source || '?' ELSE 'What is it?' END AS last_prompt
FROM documents""")
def resolve_chains(t: Tables) -> DataFrame:
    """The chain a run uses: its own, or its single prompt with defaults."""
    chain = F.expr(
        "CASE WHEN n_chars % 3 = 0 THEN array(named_struct('step_number', 1, 'system_message', 'first', 'prompt', 'Describe'),"
        " named_struct('step_number', 2, 'system_message', 'second', 'prompt', 'Look at {output1}')) END"
    ).cast(PROMPT_CHAIN)
    rows = t.given("documents").select(
        "doc_id",
        pr.resolve_chain(
            chain,
            F.expr("CASE WHEN n_chars % 3 = 1 THEN lang ELSE '' END"),
            F.expr("CASE WHEN n_chars % 2 = 0 THEN 'Is it ' || source || '?' END"),
            F.lit("binary"), F.array().cast("array<string>"), F.lit("What is it?"),
        ).alias("chain"),
    )
    size = F.size("chain")
    return rows.select(
        "doc_id", size.alias("steps"), F.get("chain", F.lit(0))["system_message"].alias("system_message"),
        F.get("chain", size - 1)["prompt"].alias("last_prompt"),
    )


@query(
    with_views("answers")
    + """SELECT evaluation_id, image_id, CASE WHEN has_step1 THEN 'Describe it. | Given step one, is it ' || project_id || '?' ELSE 'Describe it.' END AS prompts
FROM answers"""
)
def replay_prompts(t: Tables) -> DataFrame:
    """The prompts every stored result was asked, out of its chain and step outputs."""
    chain = F.array(
        F.struct(F.lit("Describe it.").alias("prompt")),
        F.struct(F.concat(F.lit("Given {output1}, is it "), F.col("project_id"), F.lit("?")).alias("prompt")),
    )
    rows = results(t).withColumn("chain", chain)
    return rows.select(
        "evaluation_id", "image_id", F.array_join(pr.replay_prompts("chain", "steps"), " | ").alias("prompts")
    )
