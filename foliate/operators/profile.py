"""Document features, type and chunk size; OCR quality; keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators.structure import is_table

# Patterns that speak for a type of document.
REFERENCE = [r"^[A-Z]{2,}\b", r"\b(See|see)\s+[A-Z][a-z]+\.", r"^\s*[A-Z][A-Z\s]+[A-Z]\s*,", r"in\s+(botany|medicine|theology|geography)"]
ADMINISTRATIVE = [
    r"Colonial\s+Office", r"Secretary\s+of\s+State", r"H\.?\s*M\.?\s*Government", r"Governor\s+and\s+Commander",
    r"\b(Chief|Assistant|Deputy)\s+(Commissioner|Secretary)", r"(£|\$)\s*\d+[,\d]*", r"^\s*\|[^|]*\|",
]
REPORT = [r"REPORT\s+FOR\s+\d{4}", r"COLONIAL\s+REPORTS", r"(Revenue|Expenditure|Financial)", r"His\s+Majesty['’]?s\s+Government", r"^\s*I\.—|II\.—|III\.—", r"ADMINISTRATION|ESTABLISHMENT"]
ENTRY, ROMAN, MONEY = r"^[A-Z]{2,}[A-Z\s]*[A-Z]\s*,", r"^\s*[IVX]+\.—", r"[£$]\s*\d+"
# Phrases of colonial discourse by category.
MARKERS = {
    "administrative_colonial": [r"Colonial\s+Office", r"Governor\s+and\s+Commander", r"Her\s+Majesty['’]?s\s+Government", r"British\s+Empire"],
    "hierarchical_language": [r"native\s+administration", r"tribal\s+authority", r"barbarous\s+customs", r"civiliz[ei]ng\s+mission"],
    "territorial_control": ["Protectorate", r"Crown\s+Colony", "Dependencies", r"British\s+jurisdiction"],
}
# Patterns of recognition errors by category.
OCR_ERRORS = {
    "character_substitution": ["[il1|]{2,}", "rn", "cl", "tn", "[0O]{2,}"],
    "word_breaks": [r"\b[a-z]{1,2}\s[a-z]{1,2}\b", r"\b[A-Z]{1}[a-z]+[A-Z]{1}[a-z]+\b"],
    "punctuation_errors": ["[.]{2,}", "[,]{2,}", "[;:]{2,}", r"\s+[.,:;]"],
    "spacing_issues": [r"\s{3,}", "[a-zA-Z][.,:;][a-zA-Z]", r"\b[a-z]+[A-Z]"],
    "table_structure": [r"\|\s*\|", r"\|[^|\n]{100,}", r"^[^|]*\|[^|]*$"],
}
# Spellings of the period that look like errors.
HISTORICAL = {"archaic_spelling": [r"\b\w*[ye]\b", r"\b[A-Z][a-z]*[ſ][a-z]*\b", r"\b\w*[ae]\b"], "abbreviations": [r"\b[A-Z]{2,}\b", r"\b[A-Z][a-z]*\.\b", r"&c\."]}
# Words that are no keywords.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "was", "are", "were", "be", "been", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "can", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them",
]
# Terms of an office list.
TERMS = {
    "ranks": r"\b(Colonel|Major|Captain|Lieutenant|Governor|Secretary)\b", "places": r"\b(Ceylon|India|Burma|Hong Kong|Jamaica|Barbados|Trinidad)\b",
    "years": r"\b(18\d{2}|19\d{2})\b", "offices": r"\b(Colonial Office|Crown Colony|Protectorate|Administration)\b",
}
# Words that tell the content of a paragraph.
CONTENT = {
    "personnel": ("governor", "secretary", "officer", "clerk", "chief"), "rules": ("regulation", "rule", "procedure", "shall be", "appointed"),
    "places": ("colony", "province", "district", "territory", "island"), "finance": ("£", "salary", "allowance", "pension", "expense"),
    "letters": ("letter", "despatch", "telegram", "dated", "received"),
}
# Words that tell the content of a section.
TOPICS = {
    "geographical": "Situation|Area|Native Tribes|Climate|bounded", "historical": "history|expedition|treaty|company|1672|1874",
    "administrative": "administration|commissioner|government|colonial secretary", "judicial": "judge|court|justice|attorney", "financial": "revenue|expenditure|£|salary",
}
#: Words in small letters of which a text has one wherever it meets a pattern, in any case. Such patterns are only tried on texts with one.
LITERALS = {
    REFERENCE[1]: ("see",), REFERENCE[3]: ("botany", "medicine", "theology", "geography"),
    ADMINISTRATIVE[0]: ("colonial",), ADMINISTRATIVE[1]: ("secretary",), ADMINISTRATIVE[2]: ("government",), ADMINISTRATIVE[3]: ("commander",), ADMINISTRATIVE[4]: ("commissioner", "secretary"),
    ADMINISTRATIVE[5]: ("£", "$"), ADMINISTRATIVE[6]: ("|",),
    REPORT[0]: ("report",), REPORT[1]: ("reports",), REPORT[2]: ("revenue", "expenditure", "financial"), REPORT[3]: ("majesty",), REPORT[4]: ("i.—",), REPORT[5]: ("administration", "establishment"),
    MARKERS["administrative_colonial"][2]: ("majesty",), MARKERS["administrative_colonial"][3]: ("british",),
    **dict(zip(MARKERS["hierarchical_language"], (("native",), ("tribal",), ("barbarous",), ("mission",)))), **dict(zip(MARKERS["territorial_control"], (("protectorate",), ("crown",), ("dependencies",), ("british",)))),
}
#: Smallest and largest chunk of each type.
SIZES = {"reference": (400, 800), "administrative": (800, 1200), "government_report": (600, 1000), "narrative": (800, 1200), "legal": (600, 1000), "hybrid": (600, 1000)}


def possible(text: Column, pattern: str) -> Column | None:
    """Whether a text has one of the words of a pattern, in any case that Java's folding knows; None for a pattern without words. Null for null."""
    low = text
    for a, b in (("ſ", "s"), ("ı", "i"), ("İ", "i")):  # equal to these letters in a pattern that ignores case; lower() leaves them
        low = F.replace(low, F.lit(a), F.lit(b))
    out = None
    for w in LITERALS.get(pattern, ()):
        has = F.lower(low).contains(w)
        out = has if out is None else out | has
    return out


def matches(text: Column, patterns: list[str], flags: str) -> Column:
    total = F.lit(0)
    for p in patterns:
        n, some = F.regexp_count(text, F.lit(flags + p)), possible(text, p)
        total = total + (n if some is None else F.when(some | text.isNull(), n).otherwise(0))
    return total


def has(text: Column, pattern: str) -> Column:
    """Whether a text has a phrase, in any case."""
    met, some = text.rlike(f"(?iU){pattern}"), possible(text, pattern)
    return met if some is None else some & met


def markers(text: Column) -> dict[str, Column]:
    """How many phrases of each category of discourse a text has."""
    return {k: sum((has(text, p).cast("int") for p in ps), F.lit(0)) for k, ps in MARKERS.items()}


def marker_names(text: Column) -> Column:
    """``category: pattern`` of each phrase of discourse that a text has."""
    return F.array_compact(F.array(*[F.when(has(text, p), f"{k}: {p}") for k, ps in MARKERS.items() for p in ps]))


def feature_columns(t: Column) -> dict[str, Column]:
    """Features of a text; an empty one has one empty line. Letters, white space and case follow Unicode."""
    lines, words = tx.lines(t), tx.words(t)
    n_lines, n_words = F.size(lines), F.size(words)
    return {
        "avg_line": F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x)) / n_lines,
        "short_lines": F.size(F.filter(lines, lambda x: F.length(tx.strip(x)) < 50)) / n_lines,
        "table_density": F.size(F.filter(lines, lambda x: x.contains("|") | x.contains("\t"))) / n_lines,
        "caps_density": tx.share(F.size(F.filter(words, lambda w: (F.length(w) > 2) & tx.is_upper(w))), n_words),
        "reference_signals": matches(t, REFERENCE, "(?imU)"),
        "administrative_signals": matches(t, ADMINISTRATIVE, "(?imU)"),
        "report_signals": matches(t, REPORT, "(?imU)"),
        "discourse_markers": sum(markers(t).values(), F.lit(0)),
        "has_entries": F.regexp_count(t, F.lit(f"(?mU){ENTRY}")) > 5,
        "has_money": t.rlike(f"(?U){MONEY}"),
        "has_roman": t.rlike(f"(?mU){ROMAN}"),
    }


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and a column for each feature of ``text``."""
    return docs.select("doc_id", *[c.alias(k) for k, c in feature_columns(F.col("text")).items()])


def type_columns(profile: str = "") -> dict[str, Column]:
    """``document_type, confidence`` from the features: the best sum of rules, hybrid below 0.3. ``profile`` is their struct, if any."""
    c = lambda k: F.col(f"{profile}.{k}" if profile else k)
    on = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    scores = {
        "reference": on(c("has_entries"), 0.4) + on(c("caps_density") > 0.05, 0.2) + on(c("reference_signals") > 10, 0.3),
        "administrative": on(c("administrative_signals") > 5, 0.3) + on(c("table_density") > 0.1, 0.2) + on(c("has_money"), 0.2) + on(c("discourse_markers") > 3, 0.2),
        "government_report": on(c("report_signals") > 3, 0.4) + on(c("has_roman"), 0.2) + on(c("has_money") & (c("table_density") > 0.05), 0.2),
    }
    best = F.greatest(*scores.values())
    kind = F.when(best < 0.3, "hybrid")
    for k, score in scores.items():  # ties: the first
        kind = kind.when(score == best, k)
    return {"document_type": kind, "confidence": best}


def size_columns(kind: Column, table_density: Column, avg_line: Column) -> dict[str, Column]:
    """Smallest and largest chunk of a type, larger for tables and for short lines."""

    def scaled(i: int) -> Column:
        base = F.lit(None)
        for k, v in SIZES.items():
            base = F.when(kind == k, v[i]).otherwise(base)
        base = F.when(table_density > 0.1, (base * F.lit(1.2)).cast("int")).otherwise(base)
        return F.when(avg_line < 40, (base * F.lit(1.1)).cast("int")).otherwise(base)

    return {"min_size": scaled(0), "max_size": scaled(1)}


def bound(rows: DataFrame) -> DataFrame:
    """The same rows, whose columns are computed here and once: the optimiser moves no expression across a generator."""
    return rows.select(F.inline(F.array(F.struct(*[F.col(c) for c in rows.columns]))))


def typed(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, keep, document_type, confidence, min_size, max_size``: columns of the same row, no join."""
    rows = bound(docs.select("doc_id", *keep, F.struct(*[c.alias(k) for k, c in feature_columns(F.col("text")).items()]).alias("_f")))
    rows = bound(rows.select("doc_id", *keep, F.col("_f.avg_line").alias("_line"), F.col("_f.table_density").alias("_tables"), *[c.alias(k) for k, c in type_columns("_f").items()]))
    sizes = size_columns(F.col("document_type"), F.col("_tables"), F.col("_line"))
    return rows.select("doc_id", *keep, "document_type", "confidence", *[c.alias(k) for k, c in sizes.items()])


def content_counts(paragraphs: Column, first: int = 100) -> dict[str, Column]:
    """How many of the first paragraphs have a word of each content."""
    some = F.transform(F.slice(paragraphs, 1, first), F.lower)

    def having(words: tuple[str, ...]) -> Column:
        def any_word(p: Column) -> Column:
            out = F.lit(False)
            for w in words:
                out = out | p.contains(w)
            return out

        return F.size(F.filter(some, any_word))

    return {k: having(words) for k, words in CONTENT.items()}


def keywords(docs: DataFrame, top: int = 20, *key: str) -> DataFrame:
    """``key, keyword, tf, rank``: the most frequent words of letters longer than 3, ties by first place.

    Texts are dealt by their key once; words are counted and ranked where their text is.
    """
    key = key or ("doc_id",)
    docs = docs.select(*key, "text").repartition(*key)
    words = F.split(F.regexp_replace(F.lower("text"), r"[^a-zA-Z\s]", " "), r"\s+")
    rows = docs.select(*key, F.posexplode(words).alias("at", "keyword")).where((F.length("keyword") > 3) & ~F.col("keyword").isin(STOPWORDS))
    counts = rows.groupBy(*key, "keyword").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy(*key)
    ranked = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "first"))).withColumn("tf", F.col("n") / F.sum("n").over(w))
    return ranked.where(F.col("rank") <= top).select(*key, "keyword", "n", "tf", "rank")
