"""Per-product model contexts, prompts and source lists.

The reference builds one prompt per product in a Python loop.  Here all
products are done at once: a per-product top-N window (partial limit before
the shuffle) bounds each group, and the ordered text join is a
``collect_list`` of at most N (rank, text) pairs - never an unbounded group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import top_n_per_group
from .scoring import rank_order


@dataclass(frozen=True)
class Provider:
    """How one model provider wants its context cut and its prompt worded."""
    name: str
    priority: int
    max_items: int          # items of the ranked context used in the prompt
    questions_per_item: int
    cut_after_questions: bool   # True: cut item after appending questions
    item_chars: int
    question_prefix: str
    source_items: int       # first items whose URLs become the entry sources
    default_confidence: float
    line_fallback: bool     # parse "Q:/A:" lines when no JSON array is usable
    template: str


# --- fixed values -----------------------------------------------------------
CONTEXT_CAP = 200            # ranked documents fetched per product
ITEM_SEPARATOR = "\n---\n"
QUESTION_JOIN = "; "
SOURCES_PER_ENTRY = 3

LARGE_TEMPLATE = """You are an expert FAQ generator. Analyze the following user discussions, reviews, and comments about "{product}" and generate comprehensive FAQs.

USER DISCUSSIONS AND REVIEWS:
{content}

Based on the above content, generate 15-20 high-quality FAQs about "{product}". For each FAQ:
1. Identify common questions, concerns, and topics users discuss
2. Provide accurate, helpful answers based on the content
3. Categorize each FAQ (e.g., "Features", "Troubleshooting", "Setup", "Performance", "Comparison", "Purchase")
4. Include relevant keywords

IMPORTANT: Return your response as a valid JSON array with the following structure:
```json
[
  {
    "question": "The question text",
    "answer": "A comprehensive answer based on user discussions",
    "category": "Category name",
    "confidence": 0.85,
    "keywords": ["keyword1", "keyword2", "keyword3"]
  }
]
```

Generate the FAQs now:"""

SMALL_TEMPLATE = """Analyze these user discussions about "{product}" and generate 10 FAQs.

CONTENT:
{content}

Generate FAQs as a JSON array:
[{"question": "...", "answer": "...", "category": "...", "confidence": 0.8, "keywords": ["..."]}]

FAQs:"""

LARGE = Provider("large", 1, 100, 3, True, 500, "\nQuestions found: ", 10, 0.8, False,
                 LARGE_TEMPLATE)
SMALL = Provider("small", 2, 50, 2, False, 300, " Questions: ", 5, 0.7, True, SMALL_TEMPLATE)
# ---------------------------------------------------------------------------

PROVIDERS = (LARGE, SMALL)


def item_text(p: Provider, content="content", questions="extracted_questions") -> Column:
    """One context item: text plus up to k questions, cut to the item size.

    The large format appends the questions first and then cuts (so the cut
    may remove them); the small format cuts the text first.
    """
    qs = F.coalesce(F.col(questions), F.array().cast("array<string>"))
    tail = F.when(F.size(qs) > 0,
                  F.concat(F.lit(p.question_prefix),
                           F.array_join(F.slice(qs, 1, p.questions_per_item), QUESTION_JOIN))
                  ).otherwise(F.lit(""))
    text = F.coalesce(F.col(content), F.lit(""))
    if p.cut_after_questions:
        return F.substring(F.concat(text, tail), 1, p.item_chars)
    return F.concat(F.substring(text, 1, p.item_chars), tail)


def ranked_context(ready: DataFrame, cap: int = CONTEXT_CAP, tasks: int | None = None) -> DataFrame:
    """The ``cap`` most relevant model-ready rows per product, with ``rank``.

    ``tasks``: see ``rank.top_n_per_group``, whose levels of cuts keep a
    product that holds a large share of all rows out of any one task."""
    return top_n_per_group(ready, ["product"], rank_order(), cap, rank_col="rank", tasks=tasks)


def ordered_join(key: str, rank: str, text: Column, sep: str) -> Column:
    """Aggregate: texts of a (bounded) group joined in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), text.alias("t"))))
    return F.array_join(F.transform(pairs, lambda x: x["t"]), sep)


def prompt_context(ranked: DataFrame, p: Provider, max_items: int | None = None) -> DataFrame:
    """Per product: the joined context of the provider's first items."""
    n = max_items or p.max_items
    items = ranked.where(F.col("rank") <= n).withColumn("item", item_text(p))
    return (items.groupBy("product")
                 .agg(F.count(F.lit(1)).alias("n_items"),
                      ordered_join("product", "rank", F.col("item"), ITEM_SEPARATOR)
                      .alias("context")))


def fill_template(template: str, **cols: Column) -> Column:
    """Replace ``{name}`` placeholders by columns (literal text elsewhere)."""
    pieces: list[Column] = []
    rest = template
    while True:
        hits = [(rest.find("{" + k + "}"), k) for k in cols if rest.find("{" + k + "}") >= 0]
        if not hits:
            break
        pos, k = min(hits)
        if pos:
            pieces.append(F.lit(rest[:pos]))
        pieces.append(cols[k])
        rest = rest[pos + len(k) + 2:]
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def prompts(ranked: DataFrame, providers=PROVIDERS, max_items: dict | None = None) -> DataFrame:
    """One prompt per (product, provider).

    All providers' contexts come out of one aggregation over the ranked rows
    (one shuffle, one pass); the per-provider results are then unpivoted.
    """
    limits = {p.name: (max_items or {}).get(p.name) or p.max_items for p in providers}
    aggs = []
    for p in providers:
        n = limits[p.name]
        inside = F.col("rank") <= n
        aggs += [F.count_if(inside).alias(f"n_{p.name}"),
                 ordered_join("product", "rank",
                              F.when(inside, item_text(p)), ITEM_SEPARATOR).alias(f"c_{p.name}")]
    per_product = ranked.where(F.col("rank") <= max(limits.values())).groupBy("product").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(p.name).alias("provider"), F.lit(p.priority).alias("priority"),
                              F.col(f"n_{p.name}").alias("n_items"),
                              fill_template(p.template, product=F.col("product"),
                                            content=F.col(f"c_{p.name}")).alias("prompt"))
                     for p in providers])
    return per_product.select("product", F.inline(rows))


def context_sources(ranked: DataFrame, providers=PROVIDERS) -> DataFrame:
    """Per (product, provider): non-empty URLs of the first items, first three.

    One aggregation collects the (rank, url) pairs of the first items of the
    widest provider; each provider then slices its own prefix.
    """
    widest = max(p.source_items for p in providers)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"),
                                                 F.col("source_url").alias("u"))))
    per_product = (ranked.where(F.col("rank") <= widest).groupBy("product")
                         .agg(pairs.alias("pairs")))

    def pick(p: Provider):
        first = F.filter("pairs", lambda x: x["r"] <= p.source_items)
        urls = F.filter(F.transform(first, lambda x: x["u"]), lambda u: u.isNotNull() & (u != ""))
        return F.struct(F.lit(p.name).alias("provider"),
                        F.slice(urls, 1, SOURCES_PER_ENTRY).alias("sources"))

    return per_product.select("product", F.inline(F.array(*[pick(p) for p in providers])))


def raw_fallback(processed: DataFrame, raw: DataFrame) -> DataFrame:
    """Context rows: processed rows, plus raw rows of products with none.

    Raw rows are reshaped to the processed shape (content from ``content``,
    URL as ``source_url``, no questions).  A left-anti join on product finds
    the products without processed rows.
    """
    shaped = raw.select(
        "id", "product",
        F.coalesce(F.col("content"), F.col("title"), F.lit("")).alias("content"),
        F.array().cast("array<string>").alias("extracted_questions"),
        F.col("score").cast("long").alias("relevance_score"),
        "data_type",
        F.coalesce(F.col("url"), F.lit("")).alias("source_url"),
        F.col("score").alias("engagement_score"),
        F.lit("raw").alias("origin"))
    from .joins import small_side
    done = small_side(processed.select("product").distinct())   # one row per product
    missing = shaped.join(done, "product", "left_anti")
    return processed.withColumn("origin", F.lit("processed")).unionByName(missing)
