"""Profiles, recognition quality, keywords: queries over ``documents``, ``conversations`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import adaptive, profile, recognition, splitting, structure
from foliate.plans.chunking import LINES, UPPER, _ENTRY_LINE, _PIPES, fold_sql, rounded
from foliate.plans.registry import ORACLE_SQL, query


def count_sql(patterns: list[str], flags: str, column: str = "text") -> str:
    """DuckDB counts matches by extracting them."""
    quoted = [p.replace("'", "''") for p in patterns]
    return " + ".join(f"len(regexp_extract_all({column}, '{flags}{p}'))" for p in quoted)


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_UP = UPPER.format("x")
#: DuckDB's word characters are ASCII: other letters become one that no pattern names, for patterns with word borders.
WORDED = "regexp_replace(text, '[^\\P{L}\\x00-\\x7F]', '_', 'g')"


def any_match_sql(patterns: list[str], flags: str, column: str) -> str:
    quoted = [p.replace("'", "''") for p in patterns]
    return "(" + " + ".join(f"regexp_matches({column}, '{flags}{p}')::INT" for p in quoted) + ")"


_MARKERS = {k: any_match_sql(ps, "(?i)", "m") for k, ps in profile.MARKERS.items()}
_SHARE = "len(list_filter({0}, lambda x: {1})) / len({0})"
_FEATURES = f"""f AS (SELECT doc_id,
 list_sum(list_transform(l, lambda x: length(x))) / len(l) AS avg_line,
 {_SHARE.format('l', "length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) < 50")} AS short_lines,
 {_SHARE.format('l', "contains(x, '|') OR contains(x, chr(9))")} AS table_density,
 CASE WHEN len(w) > 0 THEN {_SHARE.format('w', f'{_UP} AND length(x) > 2')} ELSE 0 END AS caps_density,
 {count_sql(profile.REFERENCE, '(?im)', 'm')} AS reference_signals,
 {count_sql(profile.ADMINISTRATIVE, '(?im)', 'm')} AS administrative_signals,
 {count_sql(profile.REPORT, '(?im)', 'm')} AS report_signals,
 {' + '.join(_MARKERS.values())} AS discourse_markers,
 len(regexp_extract_all(m, '(?m){profile.ENTRY}')) > 5 AS has_entries,
 regexp_matches(m, '{profile.MONEY}') AS has_money, regexp_matches(m, '(?m){profile.ROMAN}') AS has_roman
 FROM (SELECT doc_id, {WORDED} AS m, string_split(text, chr(10)) AS l, {_WORDS} AS w FROM documents))"""


@query(
    "a1_features",
    f"""WITH {_FEATURES} SELECT doc_id, round(avg_line, 6) AS avg_line, round(short_lines, 6) AS short_lines, round(table_density, 6) AS table_density,
 round(caps_density, 6) AS caps_density, reference_signals::INT AS reference_signals, administrative_signals::INT AS administrative_signals,
 report_signals::INT AS report_signals, discourse_markers::INT AS discourse_markers, has_entries, has_money, has_roman FROM f""",
    documents="documents",
)
def features(documents: DataFrame) -> DataFrame:
    return rounded(profile.features(documents))


@query(
    "x4_discourse_markers",
    f"WITH d AS (SELECT doc_id, {WORDED} AS m FROM documents) SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _MARKERS.items()) + " FROM d",
    documents="documents",
)
def discourse_markers(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", *[c.alias(k) for k, c in profile.markers(F.col("text")).items()])


_BASE = {i: "CASE document_type " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in profile.SIZES.items()) + " END" for i in (0, 1)}
_WIDE = {i: f"CASE WHEN table_density > 0.1 THEN floor(({b}) * 1.2::DOUBLE)::INT ELSE {b} END" for i, b in _BASE.items()}
_SCALED = {i: f"CASE WHEN avg_line < 40 THEN floor(({b}) * 1.1::DOUBLE)::INT ELSE {b} END" for i, b in _WIDE.items()}


def _points(*rules: tuple[str, float]) -> str:
    return " + ".join(f"CASE WHEN {cond} THEN {x}::DOUBLE ELSE 0 END" for cond, x in rules)


TYPES = f"""{_FEATURES}, s AS (SELECT *,
 {_points(('has_entries', 0.4), ('caps_density > 0.05', 0.2), ('reference_signals > 10', 0.3))} AS r,
 {_points(('administrative_signals > 5', 0.3), ('table_density > 0.1', 0.2), ('has_money', 0.2), ('discourse_markers > 3', 0.2))} AS a,
 {_points(('report_signals > 3', 0.4), ('has_roman', 0.2), ('has_money AND table_density > 0.05', 0.2))} AS g FROM f),
t AS (SELECT *, greatest(r, a, g) AS best, CASE WHEN greatest(r, a, g) < 0.3 THEN 'hybrid' WHEN r = greatest(r, a, g) THEN 'reference'
 WHEN a = greatest(r, a, g) THEN 'administrative' ELSE 'government_report' END AS document_type FROM s),
types AS (SELECT doc_id, document_type, round(best, 6) AS confidence, {_SCALED[0]} AS min_size, {_SCALED[1]} AS max_size FROM t)"""


@query("x2_document_type", f"WITH {TYPES} SELECT * FROM types", documents="documents")
def document_type(documents: DataFrame) -> DataFrame:
    return rounded(profile.typed(documents))


@query("a10_basic_stats", f"WITH {LINES}, a AS (SELECT doc_id, count(*) AS n_lines, count_if(s <> '') AS filled, avg(length(line)) FILTER (s <> '') AS avg_line FROM stripped GROUP BY ALL) SELECT doc_id, length(text)::INT AS n_chars, len({_WORDS})::INT AS n_words, n_lines, filled, round(avg_line, 6) AS avg_line FROM documents JOIN a USING (doc_id)", documents="documents")
def basic_stats(documents: DataFrame) -> DataFrame:
    rows = splitting.line_table(documents).withColumn("filled", tx.strip(F.col("line")) != "")
    stats = rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("filled").alias("filled"), F.avg(F.when(F.col("filled"), F.length("line"))).alias("avg_line"))
    return rounded(documents.select("doc_id", F.length("text").alias("n_chars"), F.size(tx.words(F.col("text"))).alias("n_words")).join(stats, "doc_id"))


def _counts_sql(groups: dict[str, list[str]], flags: str) -> str:
    counts = ", ".join(f"({count_sql(p, flags, 'm')})::INT AS {k}" for k, p in groups.items())
    return f"WITH d AS (SELECT doc_id, {WORDED} AS m FROM documents) SELECT doc_id, {counts} FROM d"


@query("a11_ocr_errors", _counts_sql(profile.OCR_ERRORS, "(?i)"), documents="documents")
def ocr_errors(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", recognition.counts(F.col("text")).alias("_n")).select("doc_id", *[f"_n.{k}" for k in profile.OCR_ERRORS])


_EXAMPLES = {"repeated_stops": "[.]{2,}", "missing_spaces": "[a-zA-Z][.,:;][a-zA-Z]", "doubled_strokes": "[il1|]{2,}"}


@query(
    "o4_error_examples",
    "SELECT doc_id, " + ", ".join(f"array_to_string(list_slice(regexp_extract_all(text, '(?i){p}'), 1, 5), ' ') AS {k}" for k, p in _EXAMPLES.items()) + " FROM documents",
    documents="documents",
)
def error_examples(documents: DataFrame) -> DataFrame:
    """The first five matches of some patterns of recognition errors."""
    return documents.select("doc_id", *[F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"(?i){p}"), F.lit(0)), 1, 5), " ").alias(k) for k, p in _EXAMPLES.items()])


@query("a18_historical_features", _counts_sql(profile.HISTORICAL, ""), documents="documents")
def historical_features(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", recognition.counts(F.col("text")).alias("_n")).select("doc_id", *[f"_n.{k}" for k in profile.HISTORICAL])


@query(
    "a19_corpus_error_rate",
    f"""WITH d AS (SELECT source, {_WORDS} AS w, {WORDED} AS m FROM documents)
SELECT source, count(*) AS docs, round(sum({' + '.join(count_sql(p, '(?i)', 'm') for p in profile.OCR_ERRORS.values())}) / sum(len(w)), 6) AS error_rate FROM d GROUP BY source""",
    documents="documents",
)
def corpus_error_rate(documents: DataFrame) -> DataFrame:
    errors = sum((F.col(f"_n.{k}") for k in profile.OCR_ERRORS), F.lit(0))
    rows = documents.select("source", recognition.counts(F.col("text")).alias("_n")).select("source", "_n.words", errors.alias("errors"))
    return rounded(rows.groupBy("source").agg(F.count("*").alias("docs"), (F.sum("errors") / F.sum("words")).alias("error_rate")))


@query(
    "a14_header_consistency",
    f"""WITH {LINES}, h AS (SELECT doc_id, length(line) AS n FROM stripped WHERE {UPPER.format('line')} AND length(s) > 5)
SELECT doc_id, count(*) AS headers, round(avg(n), 6) AS avg_length, round(coalesce(var_samp(n), 0), 6) AS variance FROM h GROUP BY doc_id""",
    documents="documents",
)
def header_consistency(documents: DataFrame) -> DataFrame:
    """Lines in capitals that can be headers: how many, and how their lengths vary."""
    rows = splitting.line_table(documents).where(tx.is_upper(F.col("line")) & (F.length(tx.strip(F.col("line"))) > 5)).withColumn("n", F.length("line"))
    return rounded(rows.groupBy("doc_id").agg(F.count("*").alias("headers"), F.avg("n").alias("avg_length"), F.coalesce(F.var_samp("n"), F.lit(0.0)).alias("variance")))


_CELLS = "list_transform(string_split(trim(line, '|'), '|'), lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g'))"


@query(
    "a12_tables",
    f"""WITH {LINES}, t AS (SELECT doc_id, line_no, ({_PIPES} + 1)::INT AS cols, line FROM lines WHERE {_PIPES} >= 2),
m AS (SELECT doc_id, cols, count(*) AS n, min(line_no) AS f FROM t GROUP BY ALL), k AS (SELECT doc_id, cols AS usual_columns, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS r FROM m)
SELECT doc_id, count(*) AS table_lines, count(DISTINCT cols) AS shapes, any_value(usual_columns) AS usual_columns, count(DISTINCT cols) <= 2 AS consistent, round(coalesce(var_samp(cols), 0), 6) AS variance,
 count_if(len(list_filter(string_split(line, '|'), lambda c: length(c) > 100)) > 0) AS long_cells FROM t JOIN k USING (doc_id) WHERE r = 1 GROUP BY doc_id""",
    documents="documents",
)
def tables(documents: DataFrame) -> DataFrame:
    rows = splitting.line_table(documents).where(structure.is_table(F.col("line"))).withColumn("cols", tx.occurrences(F.col("line"), "|") + 1)
    usual = rows.groupBy("doc_id", "cols").agg(F.count("*").alias("n"), F.min("line_no").alias("f")).groupBy("doc_id").agg(F.max_by("cols", F.struct("n", -F.col("f"))).alias("usual_columns"))
    long = F.exists(F.split("line", r"\|"), lambda c: F.length(c) > 100)
    stats = rows.groupBy("doc_id").agg(F.count("*").alias("table_lines"), F.countDistinct("cols").alias("shapes"), (F.countDistinct("cols") <= 2).alias("consistent"), F.coalesce(F.var_samp("cols"), F.lit(0.0)).alias("variance"), F.count_if(long).alias("long_cells"))
    return rounded(stats.join(usual, "doc_id"))


_TRIMMED_CELLS = "list_transform(string_split(line, '|'), lambda c: length(regexp_replace(c, '^\\s+|\\s+$', '', 'g')))"


@query(
    "a13_table_consistency",
    f"""WITH {LINES}, t AS (SELECT doc_id, ({_PIPES} + 1)::INT AS cols, {_TRIMMED_CELLS} AS cells FROM lines WHERE contains(line, '|'))
SELECT doc_id, count(*) AS lines, min(cols) AS min_columns, max(cols) AS max_columns, round(coalesce(var_samp(cols), 0), 6) AS variance, round(1 - coalesce(var_samp(cols), 0) / avg(cols), 6) AS score,
 count_if(list_max(cells) > 100 OR list_min(cells) = 0) AS misaligned FROM t GROUP BY doc_id""",
    documents="documents",
)
def table_consistency(documents: DataFrame) -> DataFrame:
    """How the columns of a document's lines with a bar vary; lines with an empty cell or one of more than 100 characters are misaligned."""
    rows = splitting.line_table(documents).where(F.col("line").contains("|"))
    cells = F.transform(F.split("line", r"\|", -1), lambda c: F.length(tx.strip(c)))
    rows = rows.select("doc_id", (tx.occurrences(F.col("line"), "|") + 1).alias("cols"), ((F.array_max(cells) > 100) | (F.array_min(cells) == 0)).alias("off"))
    variance = F.coalesce(F.var_samp("cols"), F.lit(0.0))
    stats = [F.min("cols").alias("min_columns"), F.max("cols").alias("max_columns"), variance.alias("variance"), (1 - variance / F.avg("cols")).alias("score")]
    return rounded(rows.groupBy("doc_id").agg(F.count("*").alias("lines"), *stats, F.count_if("off").alias("misaligned")))


@query("a15_paragraph_structure", f"WITH {LINES} SELECT doc_id, count(*) AS paragraphs, round(avg(length(s)), 6) AS avg_length, count_if(length(s) < 50) AS very_short, count_if(length(s) > 2000) AS very_long FROM stripped WHERE s <> '' GROUP BY doc_id", documents="documents")
def paragraph_structure(documents: DataFrame) -> DataFrame:
    rows = splitting.explode_units(documents, tx.paragraphs(F.col("text"), "\n"), "pos", "s").withColumn("n", F.length("s"))
    return rounded(rows.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.avg("n").alias("avg_length"), F.count_if(F.col("n") < 50).alias("very_short"), F.count_if(F.col("n") > 2000).alias("very_long")))


@query(
    "a16_reading_order",
    f"""WITH {LINES}, n AS (SELECT doc_id, line_no, s, lead(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS t FROM stripped)
SELECT doc_id, count_if(coalesce(length(s) > 50 AND length(t) > 50 AND len(list_filter(list_slice(string_split(lower(s), ' '), 1, 5), lambda w: contains(lower(t), w))) = 0, false)) AS breaks, count(*) AS n_lines FROM n GROUP BY doc_id""",
    documents="documents",
)
def reading_order(documents: DataFrame) -> DataFrame:
    rows = splitting.line_table(documents).select("doc_id", "line_no", tx.strip(F.col("line")).alias("s"))
    rows = rows.withColumn("t", F.lead("s").over(Window.partitionBy("doc_id").orderBy("line_no")))
    shares = F.exists(F.slice(F.split(F.lower("s"), " "), 1, 5), lambda w: F.contains(F.lower("t"), w))
    return rows.groupBy("doc_id").agg(F.count_if((F.length("s") > 50) & (F.length("t") > 50) & ~shares).alias("breaks"), F.count("*").alias("n_lines"))


@query(
    "a17_readability",
    f"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s, {_WORDS} AS w FROM documents)
SELECT doc_id, len(s)::INT AS sentences, len(w)::INT AS words, round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) AS word_length, round(len(w) / len(s), 6) AS sentence_length,
 round(2 * (list_sum(list_transform(w, lambda x: length(x))) / len(w)) + 0.5 * (len(w) / len(s)), 6) AS score FROM d WHERE len(s) > 0 AND len(w) > 0""",
    documents="documents",
)
def readability(documents: DataFrame) -> DataFrame:
    s = F.filter(F.transform(F.split("text", "[.!?]+"), tx.strip), lambda x: x != "")
    rows = documents.select("doc_id", s.alias("s"), tx.words(F.col("text")).alias("w")).where((F.size("s") > 0) & (F.size("w") > 0))
    letters = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)) / F.size("w")
    rows = rows.select("doc_id", F.size("s").alias("sentences"), F.size("w").alias("words"), letters.alias("word_length"), (F.size("w") / F.size("s")).alias("sentence_length"))
    return rounded(rows.withColumn("score", 2 * F.col("word_length") + 0.5 * F.col("sentence_length")))


_STOP = ", ".join(f"'{w}'" for w in profile.STOPWORDS)


def keywords_sql(source: str, key: str, top: int, name: str = "kw") -> str:
    return f"""{name}_w AS (SELECT {key}, p, l[p] AS keyword FROM (SELECT {key}, l, unnest(range(1, len(l) + 1)) AS p FROM (SELECT {key}, regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z\\s]', ' ', 'g'), '\\s+') AS l FROM {source})) WHERE length(l[p]) > 3 AND l[p] NOT IN ({_STOP})),
{name}_c AS (SELECT {key}, keyword, count(*) AS n, min(p) AS f FROM {name}_w GROUP BY ALL),
{name} AS (SELECT *, n / sum(n) OVER (PARTITION BY {key}) AS tf, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, f) AS rank FROM {name}_c QUALIFY rank <= {top})"""


@query("x10_keywords", f"WITH {keywords_sql('documents', 'doc_id', 20)} SELECT doc_id, keyword, n, round(tf, 6) AS tf, rank::INT AS rank FROM kw", documents="documents")
def keywords(documents: DataFrame) -> DataFrame:
    return rounded(profile.keywords(documents, 20))


_ADJACENT = f"""{keywords_sql('conversations', 'conv_id, turn', 50)}, s AS (SELECT conv_id, turn, list(keyword) AS k FROM kw GROUP BY ALL),
t AS (SELECT c.conv_id, c.turn, s.k, lead(s.k) OVER w AS nk, lead(c.turn) OVER w AS nt FROM conversations c LEFT JOIN s USING (conv_id, turn) WINDOW w AS (PARTITION BY c.conv_id ORDER BY c.turn)),
sim AS (SELECT conv_id, turn, nt AS next_turn, CASE WHEN k IS NULL OR nk IS NULL THEN 0 ELSE len(list_intersect(k, nk)) / len(list_distinct(list_concat(k, nk))) END AS similarity FROM t WHERE nt IS NOT NULL)"""


def adjacent(conversations: DataFrame) -> DataFrame:
    sets = profile.keywords(conversations, 50, "conv_id", "turn").groupBy("conv_id", "turn").agg(F.collect_set("keyword").alias("k"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn").join(sets, ["conv_id", "turn"], "left")
    rows = rows.withColumns({"nk": F.lead("k").over(w), "next_turn": F.lead("turn").over(w)}).where("next_turn is not null")
    return rows.select("conv_id", "turn", "next_turn", F.coalesce(F.size(F.array_intersect("k", "nk")) / F.when(F.col("k").isNotNull() & F.col("nk").isNotNull(), F.size(F.array_union("k", "nk"))), F.lit(0.0)).alias("similarity"))


@query("x11_adjacent_similarity", f"WITH {_ADJACENT} SELECT conv_id, turn, next_turn, round(similarity, 6) AS similarity FROM sim", conversations="conversations")
def adjacent_similarity(conversations: DataFrame) -> DataFrame:
    return rounded(adjacent(conversations))


@query("x13_topic_breaks", f"WITH {_ADJACENT} SELECT conv_id, round(avg(similarity), 6) AS avg_similarity, round(min(similarity), 6) AS min_similarity, count_if(similarity < 0.2) AS breaks, count(*) AS transitions FROM sim GROUP BY ALL", conversations="conversations")
def topic_breaks(conversations: DataFrame) -> DataFrame:
    s = F.col("similarity")
    return rounded(adjacent(conversations).groupBy("conv_id").agg(F.avg(s).alias("avg_similarity"), F.min(s).alias("min_similarity"), F.count_if(s < 0.2).alias("breaks"), F.count("*").alias("transitions")))


@query(
    "x12_topic_coherence",
    f"""WITH {keywords_sql('conversations', 'conv_id, turn', 50)}, s AS (SELECT conv_id, turn, list(keyword) AS k FROM kw GROUP BY ALL),
p AS (SELECT a.conv_id, len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) AS sim FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn)
SELECT conv_id, round(avg(sim), 6) AS coherence, round(max(sim), 6) AS highest, round(min(sim), 6) AS lowest, count_if(sim > 0.3) AS related, count(*) AS pairs FROM p GROUP BY ALL""",
    conversations="conversations",
)
def topic_coherence(conversations: DataFrame) -> DataFrame:
    """Likeness of all pairs of a conversation's turns; the pairs are the feature, so a conversation's turns bound them."""
    s = F.col("similarity")
    return rounded(pair_similarities(conversations).groupBy("conv_id").agg(F.avg(s).alias("coherence"), F.max(s).alias("highest"), F.min(s).alias("lowest"), F.count_if(s > 0.3).alias("related"), F.count("*").alias("pairs")))


def pair_similarities(conversations: DataFrame) -> DataFrame:
    """``conv_id, a, b, similarity`` of all turns of a conversation: sizes and shared keywords, by joining keywords, not texts."""
    kw = profile.keywords(conversations, 50, "conv_id", "turn").select("conv_id", "turn", "keyword")
    size = kw.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    a, b = size.select("conv_id", F.col("turn").alias("a"), F.col("n").alias("na")), size.select("conv_id", F.col("turn").alias("b"), F.col("n").alias("nb"))
    shared = kw.withColumnRenamed("turn", "a").join(kw.withColumnRenamed("turn", "b"), ["conv_id", "keyword"]).where("a < b").groupBy("conv_id", "a", "b").agg(F.count("*").alias("both"))
    pairs = a.join(b, "conv_id").where("a < b").join(shared, ["conv_id", "a", "b"], "left").fillna(0, ["both"])
    return pairs.select("conv_id", "a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity"))


@query(
    "a25_conversation_scores",
    f"""WITH {_ADJACENT}, p AS (SELECT a.conv_id, len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) AS sim FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn),
c AS (SELECT conv_id, avg(sim) AS coherence FROM p GROUP BY conv_id), t2 AS (SELECT conv_id, avg(similarity) AS transition FROM sim GROUP BY conv_id),
z AS (SELECT conv_id, count(*) AS turns, avg(length(text)) AS avg_length, var_pop(length(text)) AS variance FROM conversations GROUP BY conv_id HAVING count(*) >= 2)
SELECT conv_id, turns, round(avg_length, 6) AS avg_length, round(variance, 6) AS variance, round(0.7 * coalesce(coherence, 0) + 0.3 * coalesce(transition, 0), 6) AS score FROM z LEFT JOIN c USING (conv_id) LEFT JOIN t2 USING (conv_id)""",
    conversations="conversations",
)
def conversation_scores(conversations: DataFrame) -> DataFrame:
    """Lengths of a conversation's turns, and a score of all pairs' and neighbours' likeness; conversations of one turn have none."""
    n = F.length("text")
    sizes = conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.avg(n).alias("avg_length"), F.var_pop(n).alias("variance")).where("turns >= 2")
    pairs = pair_similarities(conversations).groupBy("conv_id").agg(F.avg("similarity").alias("c"))
    steps = adjacent(conversations).groupBy("conv_id").agg(F.avg("similarity").alias("t"))
    score = 0.7 * F.coalesce("c", F.lit(0.0)) + 0.3 * F.coalesce("t", F.lit(0.0))
    return rounded(sizes.join(pairs, "conv_id", "left").join(steps, "conv_id", "left").select("conv_id", "turns", "avg_length", "variance", score.alias("score")))


_GROUPS = {"turns": 1, "pairs": 2, "triples": 3}
_SCORED = " UNION ALL ".join(f"SELECT '{name}' AS strategy, score FROM ({ORACLE_SQL['a25_conversation_scores'].replace('conversations', f'grouped_{k}')})" for name, k in _GROUPS.items())


@query(
    "a24_strategy_scores",
    "WITH " + ", ".join(f"grouped_{k} AS MATERIALIZED (SELECT conv_id, turn // {k} AS turn, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id, turn // {k})" for k in _GROUPS.values())
    + f" SELECT strategy, round(avg(score), 5) AS avg_score, count(*) AS tested FROM ({_SCORED}) GROUP BY strategy",
    conversations="conversations",
)
def strategy_scores(conversations: DataFrame) -> DataFrame:
    """Mean score of the ways to chunk a conversation, by one, two or three turns, over all that have two chunks."""
    out = None
    for name, k in _GROUPS.items():
        turns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
        made = conversations.groupBy("conv_id", F.floor(F.col("turn") / k).alias("no")).agg(turns.alias("text")).withColumnRenamed("no", "turn")
        scores = conversation_scores(made).select(F.lit(name).alias("strategy"), "score")
        out = scores if out is None else out.union(scores)
    return out.groupBy("strategy").agg(F.round(F.avg("score"), 5).alias("avg_score"), F.count("*").alias("tested"))


@query(
    "a28_term_counts",
    f"WITH d AS (SELECT doc_id, {WORDED} AS m FROM documents) SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(m, '(?i){p}'))::INT AS {k}" for k, p in profile.TERMS.items()) + " FROM d",
    documents="documents",
)
def term_counts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", *[F.regexp_count("text", F.lit(f"(?iU){p}")).alias(k) for k, p in profile.TERMS.items()])


@query(
    "a29_content_types",
    "WITH d AS (SELECT doc_id, list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), 1, 100) AS p FROM documents) SELECT doc_id, "
    + ", ".join("len(list_filter(p, lambda x: " + " OR ".join(f"contains(lower(x), '{w}')" for w in words) + f"))::INT AS {k}" for k, words in profile.CONTENT.items()) + " FROM d",
    documents="documents",
)
def content_types(documents: DataFrame) -> DataFrame:
    """Of the first hundred paragraphs, how many have words of each content."""
    return documents.select("doc_id", *[c.alias(k) for k, c in profile.content_counts(tx.paragraphs(F.col("text"), "\n")).items()])


@query("label_gates", "SELECT source, count(*) AS labelled, round(avg(quality), 6) AS good, round(avg(toxic), 6) AS toxic, avg(quality) >= 0.8 AS passes FROM documents JOIN labels USING (doc_id) GROUP BY source", documents="documents", labels="labels")
def label_gates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "source").join(labels, "doc_id")
    return rounded(rows.groupBy("source").agg(F.count("*").alias("labelled"), F.avg("quality").alias("good"), F.avg("toxic").alias("toxic"), (F.avg("quality") >= 0.8).alias("passes")))


@query("j10_unlabelled", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", documents="documents", labels="labels")
def unlabelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("w14_context_snippets", "SELECT doc_id, instr(text, '. ')::INT AS pos, substring(text, greatest(instr(text, '. ') - 50, 1), 101) AS snippet FROM documents WHERE contains(text, '. ')", documents="documents")
def context_snippets(documents: DataFrame) -> DataFrame:
    at = F.instr("text", ". ")
    return documents.where(F.col("text").contains(". ")).select("doc_id", at.alias("pos"), F.substring(F.col("text"), F.greatest(at - 50, F.lit(1)), F.lit(101)).alias("snippet"))


_LINES_OF = "(SELECT doc_id, i - 1 AS pos, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM plain)))"
_SENTS_OF = "(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, s FROM (SELECT doc_id, i, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM plain))) WHERE s <> '')"
_OPENS = """CASE kd WHEN 'reference' THEN r.n > 0 AND ((mk AND (r.len >= mn OR r.m >= 3)) OR r.len > mx) WHEN 'administrative' THEN NOT (mk AND r.last) AND r.len > mx
 WHEN 'government_report' THEN r.n > 0 AND r.len + 2 + l > mx ELSE r.n > 0 AND r.len + 1 + l > mx END"""
_SEP = "CASE kd WHEN 'government_report' THEN 2 ELSE 1 END"
ADAPTIVE = f"""plain AS (SELECT doc_id, text FROM documents), {TYPES},
units AS (SELECT x.doc_id, CASE WHEN document_type = 'government_report' THEN row_number() OVER (PARTITION BY x.doc_id ORDER BY pos) - 1 ELSE pos END AS pos, s, document_type AS kd, min_size AS mn, max_size AS mx FROM {_LINES_OF} x JOIN types USING (doc_id) WHERE document_type IN ('reference', 'administrative') OR (document_type = 'government_report' AND s <> '')
 UNION ALL SELECT x.doc_id, pos, s, document_type, min_size, max_size FROM {_SENTS_OF} x JOIN types USING (doc_id) WHERE document_type = 'hybrid'),
{fold_sql('units', _OPENS, _SEP, f"CASE kd WHEN 'reference' THEN {_ENTRY_LINE} WHEN 'administrative' THEN contains(s, '|') OR contains(s, chr(9)) ELSE false END", ', kd, mn, mx')},
cs AS (SELECT doc_id, g, count(*) AS units, (sum(l) + (count(*) - 1) * any_value({_SEP}))::BIGINT AS size FROM r JOIN u USING (doc_id, pos) GROUP BY doc_id, g HAVING sum(l) > 0),
made AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INT AS chunk_index, units, size, document_type FROM cs JOIN types USING (doc_id))"""


@query(
    "c8_adaptive_chunks",
    f"WITH RECURSIVE {ADAPTIVE} SELECT * FROM made",
    documents="documents",
)
def adaptive_chunks(documents: DataFrame) -> DataFrame:
    return adaptive.chunks(documents).select("doc_id", "chunk_index", "units", "size", "document_type")


@query(
    "a3_document_results",
    f"""WITH RECURSIVE {ADAPTIVE} SELECT d.doc_id, count(m.doc_id) AS chunk_count, coalesce(sum(size), 0)::BIGINT AS total_chars,
 round(coalesce(avg(size), 0), 6) AS avg_chunk_size FROM documents d LEFT JOIN made m USING (doc_id) GROUP BY d.doc_id""",
    documents="documents",
)
def document_results(documents: DataFrame) -> DataFrame:
    return rounded(adaptive.summary(documents, adaptive.chunks(documents)))


@query(
    "a2_type_statistics",
    f"""WITH RECURSIVE {ADAPTIVE} SELECT document_type, count(DISTINCT doc_id) AS docs, count(*) AS chunks, round(avg(size), 6) AS avg_size,
 min(size) AS min_size, max(size) AS max_size FROM made GROUP BY document_type""",
    documents="documents",
)
def type_statistics(documents: DataFrame) -> DataFrame:
    sizes = [F.avg("size").alias("avg_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size")]
    return rounded(adaptive.chunks(documents).groupBy("document_type").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("chunks"), *sizes))


_NAMED = ", ".join(f"CASE WHEN regexp_matches(m, '(?i){p}') THEN '{k}: {p}' END".replace("['’]", "[''’]") for k, ps in profile.MARKERS.items() for p in ps)


@query(
    "c8d_chunk_metadata",
    f"""WITH RECURSIVE {ADAPTIVE}, nm AS (SELECT doc_id, array_to_string(list_filter([{_NAMED}], lambda x: x IS NOT NULL), ',') AS markers_detected FROM (SELECT doc_id, {WORDED} AS m FROM documents))
SELECT doc_id, chunk_index, document_type, round(confidence, 6) AS document_confidence, size, markers_detected <> '' AS colonial_discourse_detected, markers_detected FROM made JOIN (SELECT doc_id, confidence FROM types) USING (doc_id) JOIN nm USING (doc_id)""",
    documents="documents",
)
def chunk_metadata(documents: DataFrame) -> DataFrame:
    """Type, confidence, index and bias flags of the document on each of its chunks."""
    rows = adaptive.with_metadata(documents).withColumn("markers_detected", F.array_join("markers_detected", ","))
    return rounded(rows.select("doc_id", "chunk_index", "document_type", "document_confidence", "size", "colonial_discourse_detected", "markers_detected"))


@query(
    "c8e_results_or_errors",
    f"""WITH RECURSIVE {ADAPTIVE} SELECT d.doc_id, count(m.doc_id) AS chunk_count, any_value(CASE WHEN d.text IS NULL THEN 'no text' END) AS error
FROM documents d LEFT JOIN made m USING (doc_id) GROUP BY d.doc_id""",
    documents="documents",
)
def results_or_errors(documents: DataFrame) -> DataFrame:
    """A row for each document, with what kept it from being chunked; a document's fault touches no other."""
    made = adaptive.chunks(documents, isolate=True).groupBy("doc_id").agg(F.count("chunk_index").alias("n"), F.max("error").alias("error"))
    return documents.select("doc_id").join(made, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("chunk_count"), "error")


@query(
    "a18b_quality_bundle",
    f"""WITH d AS (SELECT doc_id, {WORDED} AS m, {_WORDS} AS w, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, len(w)::INT AS words, ({' + '.join(count_sql(p, '(?i)', 'm') for p in profile.OCR_ERRORS.values())})::INT AS errors, ({' + '.join(count_sql(p, '', 'm') for p in profile.HISTORICAL.values())})::INT AS historical,
 len(list_filter(l, lambda x: contains(x, '|')))::INT AS table_lines, len(list_filter(l, lambda x: {_UP} AND length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) > 5))::INT AS headers FROM d""",
    documents="documents",
)
def quality_bundle(documents: DataFrame) -> DataFrame:
    """The counts of a document's quality in one row, from one scan."""
    t = F.col("text")
    errors, old = (sum((F.col(f"_n.{k}") for k in group), F.lit(0)) for group in (profile.OCR_ERRORS, profile.HISTORICAL))
    tables = F.size(F.filter(tx.lines(t), lambda x: x.contains("|")))
    headers = F.size(F.filter(tx.lines(t), lambda x: tx.is_upper(x) & (F.length(tx.strip(x)) > 5)))
    rows = documents.select("doc_id", recognition.counts(t).alias("_n"), tables.alias("table_lines"), headers.alias("headers"))
    return rows.select("doc_id", "_n.words", errors.alias("errors"), old.alias("historical"), "table_lines", "headers")
