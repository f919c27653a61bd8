"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of an item, or a shorter item as a whole. Its tokens are shingles of three words (of
fewer where the window has fewer). A document holds the window only if it holds all its tokens, so joining the rarest one
by corpus frequency is enough; places where the window would begin before the document or end behind it are ruled out, and
what is left is compared word by word.

One pass over the documents keeps, for each row, the places of tokens that some window has, with the words around them;
frequencies, join and check work on those. The tokens stand in the plan as a set up to ``LITERAL_TOKENS``; more of them
are joined.

Cases: null texts and items have no words; items without words are left out. Repeated rows come back each. Equal windows
of several items count for each item. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.tables import ascii_lower, stored

# fixed value: a word, after lower-casing A-Z
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, TOKEN = 10, 3
LITERAL_TOKENS = 50_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _token(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(words, at + k) for k in range(size)))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window_id, words, tokens) of the distinct windows, and (window_id, item_id)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))
    pieces = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(window)))).alias("words"))
    pieces = pieces.select("item_id", "words", F.concat_ws(" ", "words").alias("window_id")).distinct()
    distinct = pieces.select("window_id", "words").distinct()
    tokens = F.when(F.size("words") == 1, F.array(_token(F.col("words"), F.lit(0), 1))).when(F.size("words") == 2, F.array(_token(F.col("words"), F.lit(0), 2)))
    tokens = tokens.otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - TOKEN)), lambda i: _token(F.col("words"), i, TOKEN)))
    return distinct.select("window_id", "words", tokens.alias("tokens")), pieces.select("window_id", "item_id")


def _places(docs: DataFrame, tokens: DataFrame, sizes: list[int], window: int, literal_tokens: int) -> DataFrame:
    """rid, doc_id, n_words and ``hits``: token, place, and the words around the place with the place of their first."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_of(F.col("text")).alias("w"))

    def around(at: Column, token: Column) -> Column:
        first = F.greatest(F.lit(0), at - (window - 1))
        return F.struct(token.alias("token"), at.alias("at"), first.alias("first"), F.slice("w", first + 1, at + window + TOKEN - first).alias("near"))

    known = [r["token"] for r in tokens.limit(literal_tokens + 1).collect()]
    all_tokens = lambda k: F.transform("w", lambda x, i: F.when(i + k <= F.size("w"), _token(F.col("w"), i, k)))
    if len(known) <= literal_tokens:
        if not known:
            return rows.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.array().cast("array<struct<token:bigint,at:int,first:int,near:array<string>>>").alias("hits"))

        def hits(k: int) -> Column:
            marked = F.transform(all_tokens(k), lambda t, i: F.when(t.isin(known), F.struct(t.alias("t"), i.alias("i"))))
            return F.transform(F.filter(marked, lambda m: m.isNotNull()), lambda m: around(m["i"], m["t"]))

        return rows.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.concat(*map(hits, sizes)).alias("hits"))
    table = stored(rows, "document-words")
    placed = [table.select("rid", F.posexplode(all_tokens(k)).alias("at", "token")) for k in sizes]
    found = placed[0]
    for more in placed[1:]:
        found = found.union(more)
    found = found.join(tokens, "token", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("token", "at")).alias("p"))
    joined = table.join(found, "rid", "left")
    return joined.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.transform(F.coalesce("p", F.array().cast("array<struct<token:bigint,at:int>>")), lambda p: around(p["at"], p["token"])).alias("hits"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literal_tokens: int = LITERAL_TOKENS) -> DataFrame:
    """rid, doc_id, n_words, n_hit and ``items`` (sorted item ids as strings) of each row of ``docs``."""
    windows, owners = item_windows(benchmark, window)
    windows = stored(windows, "windows")
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(TOKEN))).distinct().collect()) or [TOKEN]
    tokens = windows.select(F.explode("tokens").alias("token")).distinct()
    places = stored(_places(docs, tokens, sizes, window, literal_tokens), "places")
    hits = places.where(F.size("hits") > 0).select("rid", "n_words", F.explode("hits").alias("h")).select("rid", "n_words", "h.*")
    frequency = hits.groupBy("token").agg(F.count("*").alias("n"))
    each = windows.select("window_id", "words", F.posexplode("tokens").alias("offset", "token")).join(frequency, "token")
    # a window one of whose tokens no document has cannot occur; the others are joined by their rarest token
    rarest = each.groupBy("window_id").agg(F.min(F.struct("n", "offset", "token", "words")).alias("r"), F.count("*").alias("_has"))
    whole = windows.select("window_id", F.size("tokens").alias("_all"))
    prefix = rarest.join(whole, "window_id").where("_has = _all").select("window_id", "r.token", "r.offset", "r.words")
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.size("words") <= F.col("n_words"))
    same = F.slice("near", start - F.col("first") + 1, F.size("words")) == F.col("words")
    exact = hits.join(prefix, "token").where(inside).where(same).select("rid", "window_id", start.alias("start"), F.size("words").alias("size"))
    exact = stored(exact, "occurrences")
    covered = exact.groupBy("rid").agg(F.collect_set(F.struct("start", "size")).alias("s"))
    covered = covered.select("rid", F.size(F.array_distinct(F.flatten(F.transform("s", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))).cast("long").alias("n_hit"))
    items = exact.select("rid", "window_id").distinct().join(owners, "window_id").groupBy("rid").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = places.select("rid", "doc_id", "n_words").join(covered, "rid", "left").join(items, "rid", "left")
    return out.select("rid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op10_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window. Rows that share a doc_id go together."""
    bad = contamination(docs, benchmark).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
