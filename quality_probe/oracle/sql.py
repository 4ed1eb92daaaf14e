"""Expected results in DuckDB SQL, written from the definitions and not from the Spark plans."""

from quality_probe.functions.templates import TEMPLATES
from quality_probe.sources.items import SUBJECTS, TYPES

BLANK = r"[ \n\t\r]"
NOT_BLANK = r"[^ \n\t\r]"


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{BLANK}+'), lambda w: w <> '')"


def grams(column: str) -> str:
    return f"list_concat({column}, list_transform(range(1, len({column})), lambda i: {column}[i] || ' ' || {column}[i + 1]))"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# --- items ---------------------------------------------------------------------------------------

PARTS = f"""parts AS (
  SELECT item_id, text, {words('text')} AS w, {listed(TYPES)}[(item_id % 8 + 1)::INT] AS benchmark_type,
         (item_id % 8)::INT AS type_pos, {listed(SUBJECTS)}[((item_id // 8) % 5 + 1)::INT] AS subject,
         ((item_id // 8) % 5 + 1)::INT AS subject_no, (item_id % 4)::INT AS a, (item_id % 2)::INT AS b
  FROM benchmark),
options AS (
  SELECT *, w[1:4] AS o,
         array_to_string(list_transform(w[1:4], lambda x, i: chr((64 + i)::INT) || '. ' || x), chr(10)) AS lettered,
         array_to_string(list_transform(w[1:4], lambda x: '- ' || x), chr(10)) AS bulleted
  FROM parts)"""

FIELDS = {
    "mmlu": dict(subject="subject", question="text", choices="lettered", answer="chr(65 + a)"),
    "gsm8k": dict(question="text", answer="w[-1]"),
    "gpqa": dict(problem="text", solution="array_to_string(o, ' ')"),
    "arc_challenge": dict(question="text", choices="lettered", answer="chr(65 + a)"),
    "arc_easy": dict(question="text", choices="lettered", answer="chr(65 + a)"),
    "hellaswag": dict(context="text", endings="lettered", answer="chr(65 + a)"),
    "piqa": dict(goal="text", sol1="w[1]", sol2="w[2]", answer="chr(65 + b)"),
    "truthfulqa": dict(question="text", best_answer="w[1]", correct_answers="bulleted"),
}


def rendered(name: str) -> str:
    text = "'" + TEMPLATES[name].replace("\n", "' || chr(10) || '") + "'"
    for field, value in FIELDS[name].items():
        text = text.replace("{" + field + "}", f"' || {value} || '")
    return text


CASES = " ".join(f"WHEN '{n}' THEN {rendered(n)}" for n in TYPES)

ITEMS = f"""{PARTS},
keyed AS (
  SELECT *, CASE benchmark_type {CASES} END AS item_text,
         CASE WHEN benchmark_type = 'mmlu' THEN subject_no ELSE 0 END AS subject_pos,
         CASE WHEN benchmark_type = 'mmlu' THEN lpad(item_id::VARCHAR, 20, '0')
              ELSE md5('42|' || benchmark_type || '|' || item_id) END AS order_key
  FROM options),
items AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY type_pos, subject_pos, order_key) - 1 AS item_pos, type_pos, benchmark_type,
         (row_number() OVER (PARTITION BY type_pos ORDER BY subject_pos, order_key) - 1)::INT AS benchmark_index,
         CASE WHEN benchmark_type = 'mmlu' THEN subject END AS subject, item_text AS text
  FROM keyed)"""

# --- corpora -------------------------------------------------------------------------------------

META = "id, source, contains_benchmark, benchmark_type, benchmark_index"

WEB = """web AS (
  SELECT doc_id AS doc_pos, 'web_' || doc_id AS id, 'web' AS source, text, false AS contains_benchmark,
         NULL::VARCHAR AS benchmark_type, NULL::INT AS benchmark_index, NULL::VARCHAR AS benchmark_subject,
         text AS original_text
  FROM documents)"""

APART = """corpus AS MATERIALIZED (
  SELECT * FROM web
  UNION ALL
  SELECT item_pos + (SELECT count(*) FROM documents), benchmark_type || '_' || benchmark_index, benchmark_type, text,
         true, benchmark_type, benchmark_index, subject, text
  FROM items)"""

WEB_ONLY = "corpus AS MATERIALIZED (SELECT * FROM web)"

PLACED = """bounds AS (
  SELECT *, (type_pos * n) // 8 AS range_start, least(((type_pos + 1) * n) // 8, n - 1) AS range_end
  FROM items, (SELECT count(*) AS n FROM documents)),
placed AS MATERIALIZED (
  SELECT *, range_start + ('0x' || substr(md5('42|' || benchmark_type || '|' || benchmark_index), 1, 8))::BIGINT
         % (range_end - range_start + 1) AS doc_pos
  FROM bounds)"""

INSIDE = """touched AS (
  SELECT doc_pos, list(text ORDER BY type_pos, benchmark_index) AS texts,
         list(benchmark_type ORDER BY type_pos, benchmark_index)[-1] AS last_type,
         list(benchmark_index ORDER BY type_pos, benchmark_index)[-1] AS last_index,
         list(subject ORDER BY type_pos, benchmark_index) FILTER (subject IS NOT NULL) AS subjects
  FROM placed GROUP BY doc_pos),
corpus AS MATERIALIZED (
  SELECT w.doc_pos, w.id, w.source,
         CASE WHEN t.texts IS NULL THEN w.text ELSE list_reduce(list_concat([w.text], t.texts), lambda acc, x:
           CASE WHEN length(acc) > 5000
                THEN substr(acc, 1, length(acc) // 2) || chr(10) || chr(10) || x || chr(10) || chr(10)
                     || substr(acc, length(acc) // 2 + 1)
                ELSE acc || chr(10) || chr(10) || x END) END AS text,
         t.texts IS NOT NULL AS contains_benchmark, t.last_type AS benchmark_type, t.last_index AS benchmark_index,
         t.subjects[-1] AS benchmark_subject, w.original_text
  FROM web w LEFT JOIN touched t USING (doc_pos))"""

# --- scoring -------------------------------------------------------------------------------------

WEIGHTS = {
    "quality": ("true", "n10 + n11", "n00 + n01"),
    "toxic": ("true", "n01 + n11", "n00 + n10"),
    "good": ("true", "n10", "n00 + n01 + n11"),
    "poor": ("true", "n00 + n01", "n10 + n11"),
    "mixed": ("true", "n11", "n00 + n01 + n10"),
    "clean_quality": ("true", "n10", "n00"),
    "contrast_quality": ("true", "n10", "n01"),
    "word_quality": ("NOT is_pair", "n10 + n11", "n00 + n01"),
    "pair_quality": ("is_pair", "n10 + n11", "n00 + n01"),
    "word_toxic": ("NOT is_pair", "n01 + n11", "n00 + n10"),
}


def log_odds(name: str, pos: str, neg: str) -> str:
    return (
        f"round_even(1000000.0::DOUBLE * (ln(({pos} + 1)::DOUBLE / (h_{name} + v_{name})::DOUBLE)"
        f" - ln(({neg} + 1)::DOUBLE / (l_{name} + v_{name})::DOUBLE)), 0)::BIGINT"
    )


TOTALS = ", ".join(
    f"sum({pos}) FILTER ({used}) AS h_{n}, sum({neg}) FILTER ({used}) AS l_{n}, count(*) FILTER ({used}) AS v_{n}"
    for n, (used, pos, neg) in WEIGHTS.items()
)
LEARNED = ", ".join(
    f"CASE WHEN {used} THEN {log_odds(n, f'({pos})', f'({neg})')} END AS {n}" for n, (used, pos, neg) in WEIGHTS.items()
)
UNSEEN = ", ".join(f"{log_odds(n, '0', '0')} AS {n}" for n in WEIGHTS)

MODEL = f"""train_words AS (
  SELECT quality, toxic, {words('lower(text)')} AS w FROM documents JOIN labels USING (doc_id)),
train_grams AS (SELECT quality, toxic, unnest({grams('w')}) AS gram FROM train_words),
cells AS MATERIALIZED (
  SELECT gram, contains(gram, ' ') AS is_pair,
         count(*) FILTER (quality = 0 AND toxic = 0) AS n00, count(*) FILTER (quality = 0 AND toxic = 1) AS n01,
         count(*) FILTER (quality = 1 AND toxic = 0) AS n10, count(*) FILTER (quality = 1 AND toxic = 1) AS n11
  FROM train_grams GROUP BY gram),
totals AS MATERIALIZED (SELECT {TOTALS} FROM cells),
weights AS MATERIALIZED (SELECT gram, {LEARNED} FROM cells, totals),
unseen AS MATERIALIZED (SELECT {UNSEEN} FROM totals)"""

HEAD = f"substr(text, 1, 10000)"
TAIL = f"right(text, 10000)"
HEAD_CHUNK = f"CASE WHEN len({words(HEAD)}) > 2046 THEN array_to_string({words(HEAD)}[1:2046], ' ') ELSE {HEAD} END"
TAIL_CHUNK = f"CASE WHEN len({words(TAIL)}) > 2046 THEN array_to_string({words(TAIL)}[-2046:], ' ') ELSE {TAIL} END"


def trim_end(text: str) -> str:
    return (
        f"CASE WHEN regexp_matches({text}, '{BLANK}') THEN regexp_replace({text}, '{BLANK}{NOT_BLANK}*\\z', '')"
        f" ELSE substr({text}, 1, greatest(length({text}) - 10, 0)) END"
    )


def trim_start(text: str) -> str:
    return (
        f"CASE WHEN regexp_matches({text}, '{BLANK}') THEN regexp_replace({text}, '\\A{NOT_BLANK}*{BLANK}', '')"
        f" ELSE substr({text}, 11) END"
    )


def chunk_rows(source: str, key: str) -> str:
    """Raw and trimmed chunks of each text."""
    return f"""raw_chunks AS MATERIALIZED (
  SELECT {key}, 0 AS chunk_no, {HEAD_CHUNK} AS chunk FROM {source}
  UNION ALL
  SELECT {key}, 1, {TAIL_CHUNK} FROM {source} WHERE length(text) > 20000),
chunks AS MATERIALIZED (
  SELECT {key}, chunk_no, CASE WHEN chunk_no = 0 THEN {trim_end('chunk')} ELSE {trim_start('chunk')} END AS chunk
  FROM raw_chunks)"""


def mean(weight: str, used: str) -> str:
    """Mean weight of the grams in use, BIGINT division towards zero."""
    total = f"(sum(coalesce(w.{weight}, u.{weight})) FILTER ({used}))::BIGINT"
    return f"CASE WHEN count(g.gram) FILTER ({used}) > 0 THEN {total} // (count(g.gram) FILTER ({used})) END"


UNIT = 2**62  # of exact ratios


def exact(weight: str, used: str, sign: str = "") -> str:
    """Mean weight of the grams in use, in whole 2^-62ths, rounded down."""
    total = f"({sign}(sum(coalesce(w.{weight}, u.{weight})) FILTER ({used})))::HUGEINT * {UNIT}::HUGEINT"
    n = f"(count(g.gram) FILTER ({used}))::HUGEINT"
    return f"CASE WHEN {n} > 0 THEN ({total} - (({total} % {n}) + {n}) % {n}) // {n} END"


ANY, WORD, PAIR = "g.gram IS NOT NULL", "NOT contains(g.gram, ' ')", "contains(g.gram, ' ')"

MEANS = f"""corpus_words AS MATERIALIZED (SELECT id, {words('lower(text)')} AS w FROM corpus),
chunk_numbers AS (SELECT id, w, unnest(range(0, (len(w) + 2045) // 2046)) AS chunk_no FROM corpus_words),
view_words AS (
  SELECT id, 'full' AS view, 0 AS chunk_no, w FROM corpus_words
  UNION ALL SELECT id, 'chunk', chunk_no, w[chunk_no * 2046 + 1:(chunk_no + 1) * 2046] FROM chunk_numbers),
view_grams AS (SELECT id, view, chunk_no, unnest({grams('w')}) AS gram FROM view_words),
view_means AS MATERIALIZED (
  SELECT id, view, chunk_no, {', '.join(f"{mean(n, {'word': WORD, 'pair': PAIR}.get(n.split('_')[0], ANY))} AS {n}" for n in WEIGHTS)},
         {', '.join(f"{exact(n, {'word': WORD, 'pair': PAIR}.get(n.split('_')[0], ANY))} AS {n}_x" for n in WEIGHTS)},
         {exact('quality', ANY, 'abs')} AS quality_abs
  FROM view_grams g LEFT JOIN weights w USING (gram), unseen u
  GROUP BY id, view, chunk_no),
signals AS MATERIALIZED (
  SELECT c.doc_pos, {', '.join('c.' + m for m in META.split(', '))},
         f.quality AS full_quality, f.quality_x, f.quality_abs, f.clean_quality_x, f.contrast_quality_x,
         k.word_quality_x, k.pair_quality_x, k.word_toxic_x, f.toxic AS full_toxic, f.good AS full_good,
         f.poor AS full_poor, f.mixed AS full_mixed, f.clean_quality AS full_clean,
         f.contrast_quality AS full_contrast, k.word_quality AS chunk_word_quality,
         k.pair_quality AS chunk_pair_quality, k.word_toxic AS chunk_word_toxic
  FROM corpus c
  LEFT JOIN (FROM view_means WHERE view = 'full') f USING (id)
  LEFT JOIN (SELECT id, max(word_quality) AS word_quality, max(pair_quality) AS pair_quality,
                    max(word_toxic) AS word_toxic, max(word_quality_x) AS word_quality_x,
                    max(pair_quality_x) AS pair_quality_x, max(word_toxic_x) AS word_toxic_x
             FROM view_means WHERE view = 'chunk' GROUP BY id) k USING (id))"""


def probability(micro: str) -> str:
    return f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({micro}::DOUBLE / 1000000.0::DOUBLE))), 6)"


def clamp(value: str, low: int, high: int) -> str:
    return f"CASE WHEN {value} < {low} THEN {low}::DOUBLE WHEN {value} > {high} THEN {high}::DOUBLE ELSE {value} END"


def regression(micro: str) -> str:
    return clamp(f"(2.5::DOUBLE + {micro}::DOUBLE / 1000000.0::DOUBLE)", 0, 5)


def nearest(value: str) -> str:
    return f"round_even({value}, 0)::INT"


TOP = "greatest(full_good, full_poor, full_mixed)"
E = {c: f"exp((full_{c} - {TOP})::DOUBLE / 1000000.0::DOUBLE)" for c in ("good", "poor", "mixed")}
SHARE = f"(({E['good']} + 0.5::DOUBLE * {E['mixed']}) / ({E['good']} + {E['poor']} + {E['mixed']}))"
THREE = f"round({SHARE}, 6)"
P = probability("full_quality")

# Scorer -> score, int_score, label, binary_pred, prob.
SCORERS = {
    "binary_ngram": (P, None, None, None, None),
    "top_label": (
        f"CASE WHEN {P} >= 0.5 THEN {P} ELSE round(1 - {P}, 6) END", None,
        f"CASE WHEN {P} >= 0.5 THEN 'high_quality' WHEN {P} < 0.5 THEN 'ow_quality' END", None, None,
    ),
    "edu_regression": (regression("full_quality"), nearest(regression("full_quality")), None, None, None),
    "three_class": (THREE, nearest(clamp(f"(1 + 2 * {THREE})", 0, 3)), None, None, None),
    **{
        name: (
            f"{signal}::DOUBLE / 1000000.0::DOUBLE",
            nearest(clamp(f"({signal}::DOUBLE / 1000000.0::DOUBLE)", 0, 5)), None, None, None,
        )
        for name, signal in (
            ("chunk_edu", "chunk_word_quality"),
            ("chunk_edu_v2", "chunk_pair_quality"),
            ("chunk_binary", "chunk_word_toxic"),
        )
    },
    "edu_binary": (
        regression("full_clean"), nearest(regression("full_clean")),
        f"CASE WHEN {regression('full_clean')} >= 2.5 THEN 'high_quality'"
        f" WHEN {regression('full_clean')} < 2.5 THEN 'low_quality' END", None, None,
    ),
    "dual_head": (
        regression("full_contrast"), nearest(regression("full_contrast")), None,
        f"CASE WHEN {probability('full_toxic')} >= 0.5 THEN 1 WHEN {probability('full_toxic')} < 0.5 THEN 0 END",
        probability("full_toxic"),
    ),
}


REACH = f"{2_500_000 * UNIT}::HUGEINT"

# Scorer -> what ranks its documents: the unrounded ratio, but one value beyond the ends of a clamped range.
RANK_KEYS = {
    "binary_ngram": "quality_x",
    "top_label": "quality_abs",
    "edu_regression": f"greatest(-{REACH}, least({REACH}, quality_x))",
    "three_class": f"floor({SHARE} * 1000000000000)",
    "chunk_edu": "word_quality_x",
    "chunk_edu_v2": "pair_quality_x",
    "chunk_binary": "word_toxic_x",
    "edu_binary": f"greatest(-{REACH}, least({REACH}, clean_quality_x))",
    "dual_head": f"greatest(-{REACH}, least({REACH}, contrast_quality_x))",
}


def scores(names=None) -> str:
    """Long form of the scorers' results over `corpus`."""
    kinds = ("DOUBLE", "INT", "VARCHAR", "INT", "DOUBLE")
    columns = ("score", "int_score", "label", "binary_pred", "prob")
    parts = []
    for name in names or SCORERS:
        made = ", ".join(f"({v or 'NULL'})::{k} AS {c}" for v, k, c in zip(SCORERS[name], kinds, columns))
        key = f"CASE WHEN score IS NOT NULL THEN ({RANK_KEYS[name]})::HUGEINT END AS rank_key"
        parts.append(f"SELECT doc_pos, {META}, '{name}' AS classifier, {made}, {key} FROM signals")
    return "scores AS MATERIALIZED (\n  " + "\n  UNION ALL ".join(parts) + ")"


def scored(*more: str, select: str, names=None, corpus=APART) -> str:
    """A statement over the scored corpus with items as documents."""
    return with_(ITEMS, WEB, corpus, MODEL, MEANS, scores(names), *more, select=select)


ORDINAL = """ordinal AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY classifier ORDER BY rank_key DESC, id) AS rank,
         count(*) OVER (PARTITION BY classifier) AS total
  FROM scores WHERE score IS NOT NULL),
report AS MATERIALIZED (
  SELECT *, (total - rank) / total * 100 AS percentile FROM ordinal WHERE contains_benchmark)"""

SHARED = """ranked AS (
  SELECT *, CASE WHEN score IS NOT NULL
                 THEN rank() OVER (PARTITION BY classifier ORDER BY rank_key DESC NULLS LAST) END AS rank
  FROM scores),
shared AS MATERIALIZED (
  SELECT *, (worst - rank + 1) / worst * 100 AS percentile
  FROM (SELECT *, max(rank) OVER (PARTITION BY classifier) AS worst FROM ranked))"""


def top(n: int) -> str:
    return f"top_docs AS MATERIALIZED (SELECT *, rank AS top_rank FROM ordinal WHERE rank <= {n})"


PRESET_SCORERS = ["three_class", "edu_regression", "binary_ngram", "top_label"]
PRESET_BENCHMARKS = ["mmlu", "gsm8k", "gpqa"]
BENCHMARK_ORDER = ["gpqa", "mmlu", "gsm8k"]
SHARES = [0.1, 1, 5, 10, 25, 50, 75, 90, 95, 99, 99.9]

LABELLED = "labelled AS (SELECT * FROM web WHERE doc_pos IN (SELECT doc_id FROM labels))"
HASH = "sha256(id || ':' || text)"
FACETS = """facets AS (
  SELECT DISTINCT 'classifier' AS facet, classifier AS value FROM scores
  UNION SELECT DISTINCT 'benchmark_type', benchmark_type FROM scores WHERE benchmark_type IS NOT NULL)"""


def place(column: str, preset: list) -> str:
    return f"coalesce(list_position({listed(preset)}, {column}), 999)"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def summary(rounding) -> str:
    def mean_of(c):
        return rounding(f"avg({c})")

    def median_of(c):
        return rounding(f"median({c})")

    return f"""summary AS (
  SELECT classifier, {mean_of('rank')} AS rank_mean, {median_of('rank')} AS rank_median, min(rank) AS rank_min,
         max(rank) AS rank_max, {mean_of('percentile')} AS percentile_mean,
         {median_of('percentile')} AS percentile_median, {mean_of('score')} AS score_mean,
         {median_of('score')} AS score_median
  FROM shared WHERE contains_benchmark AND rank IS NOT NULL GROUP BY classifier)"""


def quantile(share: float) -> str:
    """Interpolated quantile of the scores of a group, from its sorted list."""
    at = f"({share!r}::DOUBLE * (count(*) - 1))"
    low, high = f"(floor({at}))::BIGINT", f"least((floor({at}))::BIGINT + 1, count(*) - 1)"
    sorted_list = "list(score ORDER BY score)"
    return f"({sorted_list}[{low} + 1] + ({sorted_list}[{high} + 1] - {sorted_list}[{low} + 1]) * ({at} - floor({at})))"


ACCEPTED = f"""accepted AS (
  SELECT doc_pos, {P} AS original_score,
         row_number() OVER (ORDER BY doc_pos) AS accepted
  FROM signals WHERE quality_x::DOUBLE / {UNIT}::DOUBLE >= 1000000 * ln(0.7::DOUBLE / 0.3::DOUBLE)),
quarter AS (SELECT count(*) // 4 AS n, count(*) AS documents FROM documents)"""


def prefilter(select: str) -> str:
    return with_(WEB, WEB_ONLY, MODEL, MEANS, ACCEPTED, select=select)



def effect(mode: str) -> str:
    """Effect rows of one mode, as text after its corpus has been scored."""
    if mode == "separate":
        return scored(
            select="""SELECT id AS doc_id, benchmark_type, benchmark_index AS "index",
  CASE WHEN benchmark_type = 'mmlu' THEN (SELECT subject FROM items i WHERE i.benchmark_type = s.benchmark_type
    AND i.benchmark_index = s.benchmark_index) END AS subject, true AS is_standalone, NULL::DOUBLE AS original_score,
  score AS benchmark_score, NULL::DOUBLE AS difference, 'separate' AS mode
FROM scores s WHERE contains_benchmark""",
            names=["binary_ngram"],
        )
    return inside_scored(
        "after AS MATERIALIZED (SELECT id, score FROM scores WHERE classifier = 'binary_ngram')",
        BEFORE,
        select="""SELECT 'web_' || p.doc_pos AS doc_id, p.benchmark_type, p.benchmark_index AS "index", p.subject,
  false AS is_standalone, b.score AS original_score, a.score AS benchmark_score,
  round(a.score - b.score, 6) AS difference, 'injected' AS mode
FROM placed p JOIN after a ON a.id = 'web_' || p.doc_pos JOIN before b ON b.id = a.id""",
        names=["binary_ngram"],
    )


def inside_scored(*more: str, select: str, names=None) -> str:
    return with_(ITEMS, WEB, PLACED, INSIDE, MODEL, MEANS, scores(names), *more, select=select)


BEFORE = f"""before_grams AS (
  SELECT id, unnest({grams('w')}) AS gram
  FROM (SELECT id, {words('lower(text)')} AS w FROM web WHERE doc_pos IN (SELECT doc_pos FROM placed))),
before AS MATERIALIZED (
  SELECT id, {probability('m')} AS score
  FROM (SELECT id, {mean('quality', ANY)} AS m FROM before_grams g LEFT JOIN weights w USING (gram), unseen u GROUP BY id))"""

RANKS = "id, benchmark_type, benchmark_index, classifier, rank, total, percentile, score"
WIDE = ", ".join(
    f"max({f}) FILTER (classifier = '{s}') AS {s}_{f}" for s in SCORERS for f in ("rank", "percentile", "score")
)
SUMMARY_TITLES = (
    'classifier AS "Classifier", rank_mean AS "Mean Rank", rank_median AS "Median Rank", rank_min AS "Best Rank", '
    'rank_max AS "Worst Rank", percentile_mean AS "Mean Percentile", percentile_median AS "Median Percentile", '
    'score_mean AS "Mean Score", score_median AS "Median Score"'
)


def two_decimals(value: str) -> str:
    return f"round_even(({value}) * 100, 0) / 100"


def template(name: str) -> str:
    return with_(PARTS, select=f"SELECT item_id, {rendered(name)} AS text FROM options")


RAW_SCORES = """raw AS (
  SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN source WHEN 1 THEN 'NaN' WHEN 2 THEN NULL
                 ELSE n_chars || '.25' END AS raw
  FROM documents),
loose AS (SELECT doc_id, TRY_CAST(raw AS DOUBLE) AS number FROM raw)"""

ITEM_DRAW = "md5('42|' || benchmark_type || '|' || item_id)"


def head(name: str, columns: str) -> str:
    return scored(select=f"SELECT id, {columns} FROM scores", names=[name])


STATEMENTS = {
    "scan_take_n": with_(WEB, select="SELECT doc_pos, id, source, text, contains_benchmark, benchmark_type, original_text "
                         "FROM web QUALIFY row_number() OVER (ORDER BY doc_pos) <= (SELECT count(*) // 2 FROM documents)"),
    "prefilter_hq": prefilter(
        "SELECT 'web_' || (accepted - 1) AS id, accepted - 1 AS doc_pos, a.doc_pos AS doc_id, original_score, text "
        "FROM accepted a JOIN documents d ON d.doc_id = a.doc_pos, quarter WHERE accepted <= n"),
    "prefilter_acceptance": prefilter(
        "SELECT count(*) AS accepted, CASE WHEN count(*) >= any_value(n) THEN max(doc_pos) + 1 "
        "ELSE any_value(documents) END AS processed, "
        "round(count(*) / (CASE WHEN count(*) >= any_value(n) THEN max(doc_pos) + 1 ELSE any_value(documents) END), 6) "
        "AS acceptance_rate FROM accepted, quarter WHERE accepted <= n"),
    "bench_first_k_per_subject": with_(
        PARTS, select="SELECT subject, item_id FROM parts QUALIFY row_number() OVER (PARTITION BY subject ORDER BY item_id) <= 3"),
    "bench_sample_strict": " UNION ALL ".join(
        f"(SELECT '{n}' AS benchmark_type, item_id FROM benchmark ORDER BY md5('42|{n}|' || item_id) LIMIT 10)"
        for n in ("gsm8k", "gpqa")),
    "bench_sample_capped": with_(
        PARTS, select="SELECT benchmark_type, item_id FROM parts WHERE benchmark_type NOT IN ('mmlu', 'gsm8k', 'gpqa') "
        f"QUALIFY row_number() OVER (PARTITION BY benchmark_type ORDER BY {ITEM_DRAW}) <= 10"),
    "bench_all_types": with_(ITEMS, select="SELECT item_pos, benchmark_type, subject, text FROM items"),
    "bench_index": with_(ITEMS, select="SELECT benchmark_type, benchmark_index, subject, text FROM items"),
    "score_store_read": scored(
        select=f"SELECT 'web' AS dataset, classifier, {HASH} AS doc_hash, id, score FROM scores JOIN (SELECT id, text FROM corpus) USING (id)"),
    "json_map_explode": scored(
        select=f"SELECT {HASH} AS doc_hash, {META}, score, int_score, binary_pred, prob "
        "FROM scores JOIN (SELECT id, text FROM corpus) USING (id)", names=["dual_head"]),
    "score_json_import": scored(
        select=f"SELECT classifier, 'web' AS dataset, {HASH} AS doc_hash, id, source, score, int_score, binary_pred, prob "
        "FROM scores JOIN (SELECT id, text FROM corpus) USING (id)", names=["dual_head"]),
    "text_json_import": with_(WEB, select="SELECT 'web' AS dataset, id, coalesce(text, '') AS text FROM web"),
    "list_datasets": "SELECT DISTINCT 'web-' || lang AS dataset FROM documents WHERE lang <> 'es'",
    **{("tmpl_arc" if n == "arc_challenge" else f"tmpl_{n}"): template(n) for n in TYPES},
    "normalize_newlines": "SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents",
    "collapse_newlines": r"SELECT doc_id, regexp_replace(text, '\n+', ' ', 'g') AS text FROM documents",
    "label_strip": "SELECT doc_id, ltrim('__label__' || lang, '__label__') AS lang_label, "
                   "ltrim('__label__' || source, '__label__') AS source_label, "
                   "ltrim('__label__' || text, '__label__') AS text_label FROM documents",
    "doc_hash": with_(WEB, select=f"SELECT id, {HASH} AS doc_hash FROM web"),
    "truncate_words": f"SELECT doc_id, array_to_string({words('text')}[1:512], ' ') AS text FROM documents",
    "chunk_head_tail": with_(chunk_rows("documents", "doc_id"), select="SELECT doc_id, chunk_no, chunk FROM raw_chunks"),
    "chunk_trim": with_(chunk_rows("documents", "doc_id"), select="SELECT doc_id, chunk_no, chunk FROM chunks"),
    "score_coerce": with_(RAW_SCORES, select="SELECT doc_id, CASE WHEN NOT isnan(number) THEN number END AS score FROM loose"),
    "drop_unscored": with_(RAW_SCORES, select="SELECT doc_id, number AS score FROM loose WHERE number IS NOT NULL AND NOT isnan(number)"),
    "inject_ranges": with_(ITEMS, PLACED, select="SELECT DISTINCT benchmark_type, range_start, range_end FROM placed"),
    "inject_positions": with_(ITEMS, PLACED, select="SELECT benchmark_type, benchmark_index, doc_pos FROM placed"),
    "inject_inside": with_(
        ITEMS, WEB, PLACED, INSIDE,
        select="SELECT doc_pos, id, text, contains_benchmark, benchmark_type, benchmark_index, benchmark_subject FROM corpus"),
    "inject_separate": with_(
        ITEMS, WEB, APART,
        select="SELECT doc_pos, id, source, text, contains_benchmark, benchmark_type, benchmark_index, benchmark_subject FROM corpus"),
    "position_log": with_(
        ITEMS, PLACED,
        select="""SELECT 'web_' || doc_pos AS doc_id, doc_pos AS doc_index, benchmark_type, benchmark_index AS "index",
  subject, 'injected' AS mode FROM placed
UNION ALL
SELECT benchmark_type || '_' || benchmark_index, item_pos + (SELECT count(*) FROM documents), benchmark_type,
  benchmark_index, subject, 'separate' FROM items"""),
    "infer_mode": with_(
        ITEMS, WEB, PLACED, INSIDE, APART.replace("corpus AS", "apart AS"),
        select="SELECT 'items apart' AS corpus, CASE WHEN bool_or(source = 'web' AND contains_benchmark) THEN 'injected' "
        "ELSE 'separate' END AS mode FROM apart UNION ALL SELECT 'items inside', CASE WHEN bool_or(source = 'web' "
        "AND contains_benchmark) THEN 'injected' ELSE 'separate' END FROM corpus"),
    "train_ngram_weights": with_(MODEL, select=f"SELECT gram, {', '.join(WEIGHTS)} FROM weights"),
    "score_ngram_hq": with_(ITEMS, WEB, APART, MODEL, MEANS, select=f"SELECT id, full_quality AS micro_logit, {P} AS score FROM signals"),
    "score_top_label": with_(
        ITEMS, WEB, APART, MODEL, MEANS,
        select=f"SELECT id, {SCORERS['top_label'][0]} AS score, {SCORERS['top_label'][2]} AS label, {P} AS p_hq FROM signals"),
    "head_edu_regression": head("edu_regression", "score, int_score"),
    "head_three_class": head("three_class", "score, int_score"),
    "head_edu_binary": head("edu_binary", "score, int_score, label"),
    "head_dual": head("dual_head", "score, int_score, binary_pred, prob"),
    "score_chunk_max": scored(select="SELECT id, classifier, score, int_score FROM scores",
                              names=["chunk_edu", "chunk_edu_v2", "chunk_binary"]),
    "score_all": scored(select="SELECT id, classifier, score, int_score, label, binary_pred, prob FROM scores"),
    "score_external_stub": with_(
        ITEMS, WEB, APART,
        select="SELECT id, length(regexp_replace(text, '[^aeiou]', '', 'g')) / length(text) AS score FROM corpus"),
    "scores_union": scored(
        select="""SELECT classifier, id, score, NULL::INT AS int_score, NULL::VARCHAR AS label, NULL::INT AS binary_pred,
  NULL::DOUBLE AS prob FROM scores WHERE classifier = 'binary_ngram'
UNION ALL BY NAME SELECT classifier, id, score, int_score, label FROM scores WHERE classifier = 'edu_binary'
UNION ALL BY NAME SELECT classifier, id, score, int_score, binary_pred, prob FROM scores WHERE classifier = 'dual_head'""",
        names=["binary_ngram", "edu_binary", "dual_head"]),
    "cache_hits": with_(WEB, LABELLED, select=f"SELECT {HASH} AS doc_hash, id FROM labelled"),
    "cache_misses": with_(WEB, select=f"SELECT {HASH} AS doc_hash, id FROM web WHERE doc_pos NOT IN (SELECT doc_id FROM labels)"),
    "cache_stats": with_(
        WEB, LABELLED, select="SELECT (SELECT count(*) FROM labelled) AS cache_hits, "
        "(SELECT count(*) FROM web) - (SELECT count(*) FROM labelled) AS cache_misses"),
    "score_with_store": with_(
        WEB, WEB_ONLY, MODEL, MEANS, scores(),
        select=f"SELECT {HASH} AS doc_hash, id, classifier, score FROM scores JOIN (SELECT id, text FROM corpus) USING (id)"),
    "top_text_merge": scored(
        ORDINAL, top(100), LABELLED,
        select="""SELECT id, 'stored earlier: ' || id AS text FROM labelled
UNION ALL
SELECT id, text FROM corpus WHERE id IN (SELECT id FROM top_docs) AND id NOT IN (SELECT id FROM labelled)"""),
    "top_docs_text": scored(
        ORDINAL, top(10), select="SELECT classifier, top_rank, id, text FROM top_docs JOIN (SELECT id, text FROM corpus) USING (id)"),
    "top_doc_cards": scored(
        ORDINAL, top(10),
        "extent AS (SELECT classifier, min(score) AS score_min, max(score) AS score_max FROM ordinal GROUP BY classifier)",
        select=f"""SELECT classifier, top_rank, id,
  printf('Score Range: %.6f (min) to %.6f (max)', score_min, score_max) AS score_range,
  printf('Top %d | %s | %s | ID: %s | Score: %.6f | Range: %.6f–%.6f%s', top_rank, classifier,
         CASE WHEN contains_benchmark THEN '🔴 BENCHMARK' ELSE '🟢 Regular' END, id, score, score_min, score_max,
         CASE WHEN contains_benchmark THEN ' | Type: ' || benchmark_type ELSE '' END) AS header,
  text
FROM top_docs JOIN extent USING (classifier) JOIN (SELECT id, text FROM corpus) USING (id)"""),
    "rank_ordinal": scored(ORDINAL, select="SELECT classifier, id, score, rank, total FROM ordinal"),
    "needle_percentile": scored(ORDINAL, select="SELECT classifier, id, rank, total, percentile, score FROM report"),
    "needle_rank_scan": scored(ORDINAL, select="SELECT classifier, id, rank, total, percentile, score FROM report"),
    "rank_min": scored(SHARED, select="SELECT classifier, id, score, rank FROM shared"),
    "percentile_minrank": scored(SHARED, select="SELECT classifier, id, rank, percentile FROM shared"),
    "top_k_per_classifier": scored(ORDINAL, top(10), select="SELECT classifier, top_rank::INT AS top_rank, id, score FROM top_docs"),
    "top_ids_union": scored(ORDINAL, top(10), select="SELECT DISTINCT id FROM top_docs"),
    "needle_summary": scored(SHARED, summary(lambda v: f"round({v}, 9)"), select="FROM summary"),
    "needle_summary_rounded": scored(SHARED, summary(two_decimals), select=f"SELECT {SUMMARY_TITLES} FROM summary"),
    "score_thresholds": scored(
        ORDINAL,
        select=" UNION ALL ".join(
            f"SELECT classifier, {float(p)!r}::DOUBLE AS p, round({quantile((100 - p) / 100)}, 10) AS threshold FROM ordinal GROUP BY classifier"
            for p in SHARES)),
    "score_stats": scored(
        ORDINAL,
        select="SELECT classifier, round(avg(score), 6) AS score_mean, min(score) AS score_min, max(score) AS score_max, "
        "round(median(score), 10) AS score_median FROM ordinal GROUP BY classifier"),
    "score_range": scored(ORDINAL, select="SELECT classifier, min(score) AS score_min, max(score) AS score_max FROM ordinal GROUP BY classifier"),
    "corpus_counts": scored(
        select="SELECT classifier, count(*) AS documents, count(score) AS scored, count(*) FILTER (contains_benchmark) AS needles, "
        "max(count(*)) OVER () AS num_docs FROM scores GROUP BY classifier"),
    "facets": scored(FACETS, select="FROM facets"),
    "preset_order": scored(
        FACETS,
        select=f"SELECT facet, value, row_number() OVER (PARTITION BY facet ORDER BY CASE WHEN facet = 'classifier' "
        f"THEN {place('value', PRESET_SCORERS)} ELSE {place('value', BENCHMARK_ORDER)} END, value)::INT AS place FROM facets"),
    "filter_benchmarks": scored(
        select=f"SELECT classifier, id, benchmark_type, score FROM scores WHERE contains_benchmark AND benchmark_type IN "
        f"{in_list([*PRESET_BENCHMARKS, 'piqa'])}"),
    "filter_classifiers": scored(
        select=f"SELECT classifier, id, score FROM scores WHERE classifier IN {in_list([*PRESET_SCORERS, 'chunk_edu'])}"),
    "rank_report_wide": scored(
        ORDINAL, select=f"SELECT id, benchmark_type, benchmark_index, {WIDE} FROM report GROUP BY id, benchmark_type, benchmark_index"),
    "rank_report_json": scored(
        ORDINAL, select="SELECT id, benchmark_type, benchmark_index, classifier, rank, percentile, score FROM report"),
    "injection_effect": f"FROM ({effect('injected')}) UNION ALL BY NAME FROM ({effect('separate')})",
    "experiment_separate": scored(ORDINAL, select=f"SELECT {RANKS} FROM report"),
    "run_reports": scored(
        ORDINAL,
        select="SELECT 'separate' AS mode, false AS prefiltered, (SELECT count(*) FROM corpus)::INT AS num_docs, 'web' AS dataset, "
        "id, benchmark_type, classifier, rank, percentile, score FROM report"),
    "experiment_injected": inside_scored(
        ORDINAL, BEFORE, "after AS MATERIALIZED (SELECT id, score FROM scores WHERE classifier = 'binary_ngram')",
        select="""SELECT r.id AS doc_id, p.benchmark_type, p.benchmark_index AS "index", p.subject, r.classifier, r.rank,
  r.percentile, r.score, b.score AS original_score, a.score AS benchmark_score, round(a.score - b.score, 6) AS difference
FROM placed p JOIN report r ON r.id = 'web_' || p.doc_pos JOIN after a ON a.id = r.id JOIN before b ON b.id = r.id"""),
    "reanalyze_store": scored(ORDINAL, select=f"SELECT 'web' AS dataset, 'separate' AS mode, {RANKS} FROM report"),
    "comparison_long": scored(
        SHARED,
        select=f"SELECT id AS benchmark_id, benchmark_type, classifier, rank, percentile, score FROM shared "
        f"WHERE contains_benchmark AND benchmark_type IN {in_list([*PRESET_BENCHMARKS, 'piqa'])}"),
    "stream_prefilter": prefilter(
        "SELECT doc_id, original_score, text FROM accepted a JOIN documents d ON d.doc_id = a.doc_pos"),
    "stream_prefilter_first": prefilter(
        "SELECT doc_id, original_score, text FROM accepted a JOIN documents d ON d.doc_id = a.doc_pos, quarter "
        "WHERE accepted <= n"),
    "stream_score_store": with_(
        WEB, WEB_ONLY, MODEL, MEANS, scores(),
        select=f"SELECT {HASH} AS doc_hash, id, classifier, score FROM scores JOIN (SELECT id, text FROM corpus) USING (id)"),
}
