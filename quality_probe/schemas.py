"""Fixed schemas of the documents, item rows, score records and stores."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

S, I, L, D, B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()


def struct(**fields):
    return StructType([StructField(name, dtype, True) for name, dtype in fields.items()])


DOCUMENT = struct(
    doc_pos=L,
    id=S,
    source=S,
    text=S,
    contains_benchmark=B,
    benchmark_type=S,
    benchmark_index=I,
    benchmark_subject=S,
    original_text=S,
    original_score=D,
)

ITEM = struct(item_pos=L, type_pos=I, benchmark_type=S, benchmark_index=I, subject=S, text=S)

POSITION = struct(doc_id=S, doc_index=L, benchmark_type=S, index=I, subject=S)

# What a scorer keeps from the document it scored.
DOCUMENT_KEYS = ["id", "source", "contains_benchmark", "benchmark_type", "benchmark_index"]

# The two rank fields tell apart what the shown score rounds to one value; both null for models without them.
SCORE_FIELDS = struct(score=D, int_score=I, label=S, binary_pred=I, prob=D, rank_high=L, rank_low=L)

SCORE = struct(
    id=S, source=S, contains_benchmark=B, benchmark_type=S, benchmark_index=I, classifier=S,
    **{field.name: field.dataType for field in SCORE_FIELDS.fields},
)

STORE = StructType([StructField("doc_hash", S, True), *SCORE.fields, StructField("dataset", S, True)])

TEXTS = struct(dataset=S, id=S, text=S)

CHOICES = struct(label=ArrayType(S), text=ArrayType(S))

# The `data` part of one raw row of each benchmark.
ITEM_DATA = {
    "mmlu": struct(question=S, choices=ArrayType(S), answer=I),
    "gsm8k": struct(question=S, answer=S),
    "gpqa": struct(problem=S, solution=S),
    "arc_challenge": struct(question=S, choices=CHOICES, answerKey=S),
    "arc_easy": struct(question=S, choices=CHOICES, answerKey=S),
    "hellaswag": struct(ctx=S, endings=ArrayType(S), label=S),
    "piqa": struct(goal=S, sol1=S, sol2=S, label=I),
    "truthfulqa": struct(question=S, best_answer=S, correct_answers=ArrayType(S)),
}


def names(schema):
    return [field.name for field in schema.fields]
