"""Shape a plain item table (item_id, text) into the raw rows of each benchmark.

Stands in for the benchmark downloads: the type of an item follows from its id, the fields from its
words.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quality_probe.functions.text import words

# Fixed values.
TYPES = ["mmlu", "gsm8k", "gpqa", "arc_challenge", "arc_easy", "hellaswag", "piqa", "truthfulqa"]
SUBJECTS = ["anatomy", "computer_security", "high_school_geography", "moral_scenarios", "college_physics"]


OPTIONS = "slice(words, 1, 4)"
ANSWER = "cast(item_id % 4 AS int)"
CHOICES = f"named_struct('label', slice(array('A', 'B', 'C', 'D'), 1, size({OPTIONS})), 'text', {OPTIONS})"
ARC = {"question": "text", "choices": CHOICES, "answerKey": f"char({ANSWER} + 65)"}

# Fields of the `data` struct that each benchmark's template reads.
FIELDS = {
    "mmlu": {"question": "text", "choices": OPTIONS, "answer": ANSWER},
    "gsm8k": {"question": "text", "answer": "try_element_at(words, -1)"},
    "gpqa": {"problem": "text", "solution": f"array_join({OPTIONS}, ' ')"},
    "arc_challenge": ARC,
    "arc_easy": ARC,
    "hellaswag": {"ctx": "text", "endings": OPTIONS, "label": f"cast({ANSWER} AS string)"},
    "piqa": {"goal": "text", "sol1": "get(words, 0)", "sol2": "get(words, 1)", "label": "cast(item_id % 2 AS int)"},
    "truthfulqa": {"question": "text", "best_answer": "get(words, 0)", "correct_answers": OPTIONS},
}


def pick(values: list, number: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast({number} % {len(values)} + 1 AS int))"


def prepared(items: DataFrame) -> DataFrame:
    """Items with their type, subject and words."""
    return items.withColumn("words", words("text")).selectExpr(
        "item_id",
        "text",
        "words",
        f"{pick(TYPES, 'item_id')} AS benchmark_type",
        f"{pick(SUBJECTS, f'(item_id div {len(TYPES)})')} AS subject",
    )


def shaped(items: DataFrame, name: str) -> DataFrame:
    fields = ", ".join(f"'{field}', {sql}" for field, sql in FIELDS[name].items())
    return items.selectExpr("item_id", "subject", f"named_struct({fields}) AS data")


def rows_as(items: DataFrame, name: str) -> DataFrame:
    """Every item as a raw row of one benchmark."""
    return shaped(prepared(items), name)


def rows_by_type(items: DataFrame) -> dict:
    """The items dealt out to the benchmarks."""
    typed = prepared(items)
    return {name: shaped(typed.filter(F.col("benchmark_type") == name), name) for name in TYPES}
