"""Model responses -> question/answer entries -> per-product documents.

Responses are a table (product, provider, priority, response).  Parsing is
all native expressions: a regex locates the JSON array, ``from_json`` reads
it permissively (malformed -> NULL, never an exception), and the line format
is rebuilt with a running-sum window (gaps and islands) over exploded lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prompts import PROVIDERS

# --- fixed values -----------------------------------------------------------
DEFAULT_CATEGORY = "General"
LINE_CONFIDENCE = 0.6
QUESTION_PREFIXES = ("Q:", "Question:")
ANSWER_PREFIXES = ("A:", "Answer:")
JSON_ARRAY_PATTERN = r"(?s)\[.*\]"      # first "[" to last "]"
# ---------------------------------------------------------------------------

ENTRY_FIELDS = ("question", "answer", "category", "confidence", "keywords")
ENTRY_STRUCT = ("struct<question:string,answer:string,category:string,"
                "confidence:string,keywords:array<string>>")
JSON_OPTIONS = {"allowSingleQuotes": "false"}
KEYS = ["product", "provider", "priority"]


def strip(c: Column) -> Column:
    """Remove leading/trailing whitespace of any kind (trim only removes spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def json_array_text(c: Column) -> Column:
    """The span from the first '[' to the last ']' ('' when there is none)."""
    return F.regexp_extract(c, JSON_ARRAY_PATTERN, 0)


def json_array(c: Column) -> Column:
    """array<string> of raw element texts; NULL when the located span is not
    a valid JSON array (or there is no span)."""
    return F.from_json(F.nullif(json_array_text(c), F.lit("")), "array<string>", JSON_OPTIONS)


def json_elements(c: Column) -> Column:
    """The elements when every one is a JSON object, else NULL (a valid array
    holding anything else makes the response unusable - no fallback)."""
    arr = json_array(c)
    ok = F.coalesce(F.forall(arr, lambda e: e.isNotNull() & e.startswith("{")), F.lit(False))
    return F.when(ok, arr)


def parse_json_entries(responses: DataFrame, providers=PROVIDERS) -> DataFrame:
    """Entries of responses holding a valid JSON array (one row per entry).

    A field of another type is read as it is written: a question that is an
    object becomes its JSON text, keywords that are not a list become empty.
    Missing fields take defaults; confidence is read as text and cast, a
    JSON boolean counts as 1.0 / 0.0 (as a number conversion of it does), and
    the provider's default applies when absent or not a number.
    """
    default_conf = F.lit(None).cast("double")
    for p in providers:
        default_conf = F.when(F.col("provider") == p.name, F.lit(p.default_confidence)) \
                        .otherwise(default_conf)
    e = (responses.withColumn("elems", json_elements(F.col("response")))
                  .where(F.col("elems").isNotNull())
                  .select(*KEYS, F.posexplode("elems").alias("pos", "raw"),
                          default_conf.alias("default_conf"))
                  .withColumn("f", F.from_json("raw", ENTRY_STRUCT, JSON_OPTIONS)))
    return e.select(
        *KEYS, F.col("pos").cast("int").alias("entry_pos"),
        F.coalesce(F.col("f.question"), F.lit("")).alias("question"),
        F.coalesce(F.col("f.answer"), F.lit("")).alias("answer"),
        F.coalesce(F.col("f.category"), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(F.expr("try_cast(f.confidence AS DOUBLE)"),
                   F.when(F.col("f.confidence") == "true", F.lit(1.0))
                    .when(F.col("f.confidence") == "false", F.lit(0.0)),
                   F.col("default_conf")).alias("confidence"),
        F.coalesce(F.col("f.keywords"), F.array().cast("array<string>")).alias("keywords"),
        F.lit("json").alias("method"))


def _starts_any(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for pre in prefixes:
        out = out | c.startswith(pre)
    return out


def parse_qa_lines(responses: DataFrame) -> DataFrame:
    """Entries from "Q:/Question:" and "A:/Answer:" lines.

    A block runs from one question line to the next (running sum of question
    lines).  Its answer is the text of its last answer line followed by the
    plain lines after it - or all plain lines when it has no answer line -
    joined by spaces.  Blocks with an empty question or answer are dropped,
    as are lines before the first question.
    """
    lines = (responses
             .select(*KEYS, F.posexplode(F.split("response", "\n")).alias("pos", "raw"))
             .withColumn("line", strip(F.col("raw")))
             .withColumn("is_q", _starts_any(F.col("line"), QUESTION_PREFIXES))
             .withColumn("is_a", ~F.col("is_q") & _starts_any(F.col("line"), ANSWER_PREFIXES))
             .withColumn("after", strip(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1))))
    w = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("block", F.sum(F.col("is_q").cast("int")).over(w)) \
                 .where(F.col("block") > 0)
    parts = F.array_sort(F.collect_list(F.struct("pos", "is_q", "is_a", "line", "after")))
    blocks = (lines.groupBy(*KEYS, "block")
                   .agg(F.min_by("after", "pos").alias("question"),
                        F.max(F.when(F.col("is_a"), F.col("pos"))).alias("last_a"),
                        parts.alias("parts")))
    a_text = F.get(F.filter("parts", lambda x: x["pos"] == F.col("last_a")), 0)["after"]
    conts = F.transform(
        F.filter("parts", lambda x: ~x["is_q"] & ~x["is_a"] & (x["line"] != "")
                 & (x["pos"] > F.coalesce(F.col("last_a"), F.lit(-1)))),
        lambda x: x["line"])
    answer = strip(F.concat_ws(" ", a_text, conts))
    return (blocks.withColumn("answer", answer)
                  .where((F.col("question") != "") & (F.col("answer") != ""))
                  .select(*KEYS, (F.col("block") - 1).cast("int").alias("entry_pos"),
                          "question", "answer",
                          F.lit(DEFAULT_CATEGORY).alias("category"),
                          F.lit(LINE_CONFIDENCE).alias("confidence"),
                          F.array().cast("array<string>").alias("keywords"),
                          F.lit("lines").alias("method")))


def parse_responses(responses: DataFrame, providers=PROVIDERS) -> DataFrame:
    """All entries: JSON where usable; line format for providers that allow it.

    A provider with ``line_fallback`` uses the line parser exactly when the
    response has no valid JSON array; a valid array with a non-object element
    yields nothing (the response is unusable).
    """
    fallback_names = [p.name for p in providers if p.line_fallback]
    json_entries = parse_json_entries(responses, providers)
    # line parsing only when there is no valid JSON array at all
    unusable = (responses.where(F.col("provider").isin(fallback_names))
                         .where(json_array(F.col("response")).isNull()))
    return json_entries.unionByName(parse_qa_lines(unusable))


def provider_fallback(entries: DataFrame, responses: DataFrame) -> DataFrame:
    """Per product: the first provider (by priority) with at least one entry.

    Products where every provider failed keep a row with NULL provider.
    """
    counts = entries.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_entries"))
    best = (counts.groupBy("product")
                  .agg(F.min_by(F.struct("provider", "n_entries"), "priority").alias("b"))
                  .select("product", F.col("b.provider").alias("provider"),
                          F.col("b.n_entries").alias("n_entries")))
    products = responses.select("product").distinct()
    return products.join(best, "product", "left")


def faq_documents(entries: DataFrame, chosen: DataFrame, sources: DataFrame,
                  source_counts: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """Per product: the chosen provider's entries nested in one document.

    Entries of the JSON path carry the provider's source list; line-parsed
    entries carry none.  ``source_counts`` = (product, source_count).
    """
    gen = generated_at if generated_at is not None else F.current_timestamp()
    e = (entries.join(chosen.where(F.col("provider").isNotNull()).select("product", "provider"),
                      ["product", "provider"], "left_semi")
                .join(sources, ["product", "provider"], "left")
                .withColumn("sources", F.when(F.col("method") == "json",
                                              F.coalesce("sources", F.array().cast("array<string>")))
                            .otherwise(F.array().cast("array<string>"))))
    entry = F.struct("question", "answer", "category", "confidence", "sources", "keywords")
    docs = (e.groupBy("product", "provider")
              .agg(F.array_sort(F.collect_list(F.struct(F.col("entry_pos").alias("p"),
                                                         entry.alias("e")))).alias("pairs"))
              .select("product", F.transform("pairs", lambda x: x["e"]).alias("faqs"),
                      F.col("provider").alias("model_used")))
    return (docs.join(source_counts, "product", "left")
                .select("product", "faqs", gen.alias("generated_at"), "model_used",
                        F.coalesce(F.col("source_count"), F.lit(0)).cast("long").alias("source_count"),
                        gen.alias("updated_at")))


def faq_entries(documents: DataFrame) -> DataFrame:
    """Documents -> one row per entry (product, entry_pos, entry fields)."""
    return (documents.select("product", "model_used", "generated_at",
                             F.posexplode("faqs").alias("entry_pos", "f"))
                     .select("product", "model_used", "generated_at",
                             F.col("entry_pos").cast("int").alias("entry_pos"), "f.*"))


def faq_report(entries: DataFrame, preview_chars: int = 200, shown_sources: int = 2) -> DataFrame:
    """Display form: confidence percent, answer preview, first sources."""
    return entries.select(
        "product", "entry_pos", "question", "category",
        F.round(F.col("confidence") * 100).cast("int").alias("confidence_pct"),
        F.substring("answer", 1, preview_chars).alias("answer_preview"),
        F.slice("sources", 1, shown_sources).alias("shown_sources"))


def faq_search(entries: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring search over question, answer and category."""
    t = F.lower(F.lit(term))
    hit = (F.lower("question").contains(t) | F.lower("answer").contains(t)
           | F.lower("category").contains(t))
    return entries.where(hit)


def faq_list(documents: DataFrame) -> DataFrame:
    """Document list with the column subset (no entries)."""
    return documents.select("product", "generated_at", "model_used", "source_count",
                            F.size("faqs").alias("faq_count"))
