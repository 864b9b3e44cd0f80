"""Prompt texts, prompt chains and references between their steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from gradeflow.functions.text import as_col, strip
from gradeflow.schemas import PROMPT_CHAIN

# System prompt per question type.
SYSTEM_PROMPTS = {
    "binary": "Reply only true or false, nothing else, only true or false depending on your judgement.",
    "multiple_choice": (
        "Reply only with one of these values: {options}\n"
        "Nothing else, just the exact value from the list above."
    ),
    "text": (
        "Reply as short as you can with classification of what you see.\n"
        "Do not go longer than absolutely necessary.\n"
        "Distil to as short and precise label as possible in reply to question."
    ),
    "count": (
        "Reply only with a number that is a count.\n"
        "Only return the number, nothing else.\n"
        "Do not show calculation details in the final output (keep it in thinking).\n"
        "Only return a number."
    ),
}
DEFAULT_PROMPT = "Answer the question based on the image."
MAX_STEPS = 5


def system_prompt(question_type: Column | str, options: Column | None = None) -> Column:
    """System prompt for a question type; lists the options of a multiple choice question."""
    qtype = F.lit(question_type) if isinstance(question_type, str) else question_type
    text = F.lit(DEFAULT_PROMPT)
    for name, prompt in SYSTEM_PROMPTS.items():
        filled: Column = F.lit(prompt)
        if name == "multiple_choice" and options is not None:
            filled = F.when(F.size(options) > 0, F.replace(filled, F.lit("{options}"), F.array_join(options, ", ")))
            filled = F.coalesce(filled, F.lit(prompt))
        text = F.when(qtype == name, filled).otherwise(text)
    return text


def references(prompt: Column | str) -> Column:
    """Sorted step numbers a prompt refers to as ``{outputN}``, duplicates kept."""
    found = F.regexp_extract_all(as_col(prompt), F.lit(r"\{output([0-9]+)\}"), F.lit(1))
    return F.array_sort(F.transform(found, lambda n: n.try_cast("int")))


def reference_error(prompt: Column | str, step_number: Column, available: Column) -> Column:
    """First reference that is not to an earlier, available step, as a message; else NULL.

    ``available`` is an array of the step numbers that produced an output.
    """
    bad = F.get(
        F.filter(references(prompt), lambda r: (r >= step_number) | ~F.array_contains(available, r)), F.lit(0)
    )
    number = bad.cast("string")
    return F.when(
        bad >= step_number,
        F.concat(F.lit("Cannot reference {output"), number, F.lit("} from step "), step_number.cast("string")),
    ).when(
        bad.isNotNull(),
        F.concat(F.lit("Variable {output"), number, F.lit("} not available (step may have failed)")),
    )


def substitute(prompt: Column | str, outputs: Sequence[tuple[int, Column]]) -> Column:
    """Put step outputs into a prompt, in step order.

    Text that was put in may itself hold a later reference and is then replaced
    too.  A reference to a step without output stays as it is.
    """
    text = as_col(prompt)
    for number, output in outputs:
        for mark in (f"{{{{output{number}}}}}", f"{{output{number}}}"):
            text = F.coalesce(F.replace(text, F.lit(mark), output), text)
    return text


def substitute_text(prompt: str, outputs: dict[int, str]) -> str:
    """The rule of :func:`substitute` for one prompt inside a task."""
    for number, output in outputs.items():
        prompt = prompt.replace(f"{{{{output{number}}}}}", output).replace(f"{{output{number}}}", output)
    return prompt


def replay_prompts(chain: Column | str, steps: Column | str) -> Column:
    """The prompts that were sent, out of a stored chain and the outputs of its steps.

    Step n sees the outputs of steps 1 to n-1; a step after a failed one was
    never sent and gives no prompt.
    """
    chain, steps = as_col(chain), as_col(steps)
    sent = []
    for number in range(1, MAX_STEPS + 1):
        before = [(m, F.get(steps, F.lit(m - 1))["raw_output"]) for m in range(1, number)]
        prompt = substitute(F.get(chain, F.lit(number - 1))["prompt"], before)
        reached = (F.size(steps) >= number - 1) & (F.size(chain) >= number)
        sent.append(F.when(reached, prompt))
    return F.array_compact(F.array(*sent))


def chain_error(chain: Column | str) -> Column:
    """First fault of a prompt chain as a message, else NULL.  NULL chains are fine."""
    chain = as_col(chain)

    def step_fault(step: Column, index: Column) -> Column:
        place = (index + 1).cast("string")
        head = F.concat(F.lit("Step "), place)
        return (
            F.when(step.isNull(), F.concat(head, F.lit(" must be a dictionary")))
            .when(step["step_number"].isNull(), F.concat(head, F.lit(" missing required field: step_number")))
            .when(step["prompt"].isNull(), F.concat(head, F.lit(" missing required field: prompt")))
            .when(
                step["step_number"] != index + 1,
                F.concat(
                    head, F.lit(" has incorrect step_number: expected "), place,
                    F.lit(", got "), step["step_number"].cast("string"),
                ),
            )
        )

    faults = F.filter(F.transform(chain, step_fault), lambda fault: fault.isNotNull())
    size = F.size(chain)
    return F.when(chain.isNull(), F.lit(None).cast("string")).when(
        (size < 1) | (size > MAX_STEPS), F.lit(f"Prompt chain must have 1-{MAX_STEPS} steps")
    ).otherwise(F.get(faults, F.lit(0)))


def resolve_chain(
    chain: Column,
    system_message: Column,
    question_text: Column,
    question_type: Column,
    options: Column,
    default_question: Column,
) -> Column:
    """The chain to run: the given one, or one step made of the single prompt of the run."""

    def given(text: Column) -> Column:
        return F.when(text != "", text)

    single = F.array(
        F.struct(
            F.lit(1).alias("step_number"),
            F.coalesce(given(system_message), strip(system_prompt(question_type, options))).alias("system_message"),
            F.coalesce(given(question_text), default_question).alias("prompt"),
        )
    ).cast(PROMPT_CHAIN)
    return F.when(F.size(chain) > 0, chain).otherwise(single)
