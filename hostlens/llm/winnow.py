"""Benchmark decontamination by winnowing (DataFrame functions only).

A text is hashed into k-grams of words.  Of every run of ``span - k + 1``
consecutive k-grams (that is, of every ``span`` words) the least hash is kept.
Two texts that share ``span`` words share the least hash of that span, so an
equi-join on kept hashes finds every such span; each hit is then extended to
the whole span by comparing the words themselves.

While the benchmark is small, documents are scanned once: a document's kept
hashes are exploded together with one marker row, so clean documents come out
of the same broadcast join.  There a long text goes on as several rows, and a
hit takes along the words around it only: a task needs memory for a piece of a
text and its hits, not for the words of a whole text, nor once more for every
hit.  Otherwise bare hashes go through the shuffle, and what they meet goes to
its document, whose words are compared there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import LOWER, UPPER, stored

SPAN = 10                      # words of a window
K = 5                          # words of a hashed k-gram
RUN = SPAN - K + 1             # k-grams of a window
BROADCAST_BYTES = 64 << 20     # benchmark windows above this are joined by a shuffle
PIECE = 1 << 16                # letters of a longer text that go on as one row
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
REST_OF_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+"  # in a text whose A-Z are not lower-cased yet


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _words(df: DataFrame) -> DataFrame:
    """Adds ws (words) and wh (their hashes)."""
    return df.withColumn("ws", _split(F.col("text"))).withColumn("wh", F.expr("transform(ws, w -> xxhash64(w))"))


def _pieces(rows: DataFrame) -> DataFrame:
    """Rows (uid, row, text) as rows uid, base, row, n_words, ws, wh of at most about
    PIECE letters.  A piece ends where a word ends; ws has its n_words words and the
    first SPAN - 1 that follow, so every window begins in one piece and is whole there.
    base: words before the piece; row comes with the first piece only."""
    def measured(piece: Column) -> Column:
        return F.transform(F.array(_split(piece)), lambda w: F.struct(
            piece.alias("text"), F.size(w).alias("n"), F.slice(w, 1, SPAN - 1).alias("head")))[0]

    # each part has a word, so the heads of the next SPAN - 1 hold all the words that may be needed
    parts = F.when(F.length("text") > PIECE, F.filter(F.transform(F.regexp_extract_all(
        "text", F.lit(rf"(?s).{{1,{PIECE}}}+{REST_OF_WORD}"), F.lit(0)), measured), lambda x: x["n"] > 0))
    several = F.transform("parts", lambda x, i: F.struct(
        F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda n, y: n + y["n"]).alias("base"),
        x["text"].alias("text"),
        F.slice(F.flatten(F.transform(F.slice("parts", i + 2, SPAN - 1), lambda y: y["head"])), 1, SPAN - 1).alias("tail"),
        F.when(i == 0, F.col("row")).alias("row")))
    whole = F.array(F.struct(F.lit(0).alias("base"), "text", F.expr("cast(array() as array<string>)").alias("tail"), "row"))
    pieces = rows.withColumn("parts", parts).select("uid", F.explode_outer(
        F.when(F.size("parts") > 1, several).otherwise(whole)).alias("piece")).select("uid", "piece.*")
    return pieces.withColumn("ws", F.concat(_split(F.col("text")), "tail")).select(
        "uid", "base", "row", F.expr("bigint(size(ws) - size(tail))").alias("n_words"), "ws").withColumn(
        "wh", F.expr("transform(ws, w -> xxhash64(w))"))


def _least(df: DataFrame) -> DataFrame:
    """Adds least: for each window start the least k-gram hash of that window."""
    grams = ", ".join(f"wh[i + {j}]" for j in range(K))
    run = ", ".join(f"g[i + {j}]" for j in range(RUN))
    none = "cast(array() as array<bigint>)"
    return df.withColumn(
        "g", F.expr(f"if(size(wh) < {SPAN}, {none}, transform(sequence(0, size(wh) - {K}), i -> xxhash64({grams})))")
    ).withColumn(
        "least", F.expr(f"if(size(wh) < {SPAN}, {none}, transform(sequence(0, size(wh) - {SPAN}), i -> least({run})))")
    ).drop("g")


def benchmark_windows(items: DataFrame) -> DataFrame:
    """Distinct windows of the items: len, key (kept hash, or the hash of the
    whole text of a short item), win (words), items (ids that hold it; a null
    id is left out)."""
    w = _least(_words(items.select(F.col("item_id").alias("item"), "text")))
    full = w.where(f"size(ws) >= {SPAN}").select(
        "item", F.expr(f"inline(transform(least, (m, i) -> named_struct('len', {SPAN}, 'key', m, 'win', slice(ws, i + 1, {SPAN}))))"))
    short = w.where(f"size(ws) between 1 and {SPAN - 1}").select(
        "item", F.expr("size(ws)").alias("len"), F.expr("xxhash64(wh)").alias("key"), F.col("ws").alias("win"))
    return full.unionByName(short).groupBy("len", "key", "win").agg(F.collect_set("item").alias("items"))


def _starts(k: str, w: str, ws: str = "ws", least: str = "least", at: str | None = None) -> str:
    """Where a kept hash k (len, at, key) that meets a window's w stands for the whole window.
    at: its place in ws and least, if they are not all of the words."""
    at = at or f"{k}.at"
    to = f"{at} + {RUN - 1} - {k}.at % {RUN}"  # the last start that this kept hash stands for
    return f"""case when {k}.len < {SPAN} then if(slice({ws}, {at} + 1, {k}.len) = {w}, array({at}), cast(array() as array<int>))
        else filter(sequence({at}, least({to}, size({least}) - 1)),
                    i -> {least}[i] = {k}.key and slice({ws}, i + 1, {SPAN}) = {w}) end"""


def _hits(rows: DataFrame, wins: DataFrame, parts: list[str]) -> DataFrame:
    """Per row: row, n_words, spans (a list per hit) and items, by a broadcast of the windows."""
    marker = rows.sparkSession.range(1).select(
        F.lit(0).alias("w_len"), F.lit(0).cast("long").alias("w_key"), F.lit(None).cast("array<string>").alias("win"),
        F.lit(None).cast(wins.schema["items"].dataType).alias("items"))
    parts = ["array(named_struct('len', 0, 'at', 0, 'key', bigint(0)))", *parts]
    d = _least(_pieces(rows)).withColumn("kept", F.expr(f"concat({', '.join(parts)})"))
    # explode_outer: for explode the optimizer would add a filter that computes kept once more
    d = d.select("uid", "base", "n_words", "row", "ws", "least", F.explode_outer("kept").alias("k"))
    hit = d.join(F.broadcast(wins.unionByName(marker)), (F.col("k.len") == F.col("w_len")) & (F.col("k.key") == F.col("w_key")))
    # The generated code of explode and join holds all hits of a row before one goes on, so it ends
    # with this projection: the words of a hit, not of its text, and the row at the marker.  Nothing
    # in it may be a function with a lambda, as in _starts: such a projection runs apart from the join.
    hit = hit.select("uid", "base", F.col("w_len").alias("len"), "k", "win", "items",
                     F.expr(f"slice(ws, k.at + 1, {SPAN + RUN - 1})").alias("near"), F.expr(f"slice(least, k.at + 1, {RUN})").alias("runs"),
                     F.expr("if(w_len = 0, n_words, null)").alias("n_words"), F.expr("if(w_len = 0, row, null)").alias("row"))
    starts = f"case when len = 0 then cast(array() as array<int>) else {_starts('k', 'win', 'near', 'runs', '0')} end"
    found = hit.select("uid", "len", "items", "n_words", "row", F.expr("base + k.at").alias("at"), F.expr(starts).alias("starts"))
    return found.groupBy("uid").agg(
        # first() would copy the whole row again for each hit
        F.sum("n_words").alias("n_words"), F.collect_list("row")[0].alias("row"),
        F.collect_list(F.expr("if(len > 0, transform(starts, s -> named_struct('start', at + s, 'len', len)), null)")).alias("spans"),
        F.collect_set(F.expr("if(size(starts) > 0, items, null)")).alias("items"))


def _far_hits(rows: DataFrame, wins: DataFrame, parts: list[str]) -> DataFrame:
    """The same by shuffles: (uid, hash) meets the windows, then a document gets
    its windows.  Texts go through a shuffle once, by uid."""
    carried = "text" in (f.name.lower() for f in rows.schema["row"].dataType.fields)
    rows, _ = stored(rows.drop("text") if carried else rows)      # uid must be the same on both ways
    text = F.col("row.text" if carried else "text").alias("text")
    kept = _least(_words(rows.select("uid", text))).select("uid", F.explode_outer(F.expr(f"concat({', '.join(parts)})")).alias("k"))
    met = kept.join(wins, (F.col("k.len") == F.col("w_len")) & (F.col("k.key") == F.col("w_key")))
    met = met.groupBy("uid").agg(F.collect_list(F.struct("k", "win", "items")).alias("met"))
    # words only where something was met; n_words of the others needs no hashes
    d = rows.join(met, "uid", "left").withColumn("text", text)
    d = _least(_words(d).withColumn("n_words", F.expr("bigint(size(ws))")).withColumn(
        "wh", F.expr("if(met is null, cast(array() as array<bigint>), wh)")))
    d = d.withColumn("found", F.expr(f"""filter(transform(coalesce(met, array()), m -> named_struct(
        'len', m.k.len, 'items', m.items, 'starts', {_starts('m.k', 'm.win')})), f -> size(f.starts) > 0)"""))
    return d.select("uid", "row", "n_words", F.expr(
        "transform(found, f -> transform(f.starts, s -> named_struct('start', s, 'len', f.len)))").alias("spans"),
        F.expr("transform(found, f -> f.items)").alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, carry: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) the words inside occurrences of ``items`` (item_id, text).

    Returns doc_id (with ``carry``: ``row``, a struct of all input columns),
    n_words, n_hit, n_items, items_sha256, items (sorted ids as text), spans
    (start and length in words of every hit window) and contaminated.

    Nulls and empty texts have no words and no hits; a null item id hits but
    is not listed.  An item without words is never found.  Repeated rows each
    give a row; no items, or no documents, is no error.  Extra columns are
    not read.  Nothing is cut: very long texts are compared whole.
    """
    wins = benchmark_windows(items)
    size = wins.agg(F.count("*").alias("n"), F.sum(F.expr(
        "64 + 16 * size(win) + octet_length(array_join(win, '')) + 8 * size(items)")).alias("b"),
        F.collect_set("len").alias("lens")).first()  # one row; lens holds at most SPAN numbers
    short = sorted(x for x in size["lens"] if x < SPAN)
    wins = wins.withColumnsRenamed({"len": "w_len", "key": "w_key"})

    # a window's hash is kept where it changes and, so that no run grows, at every RUN-th start
    kept = f"""transform(filter(sequence(0, size(wh) - {SPAN}), i -> i % {RUN} = 0 or least[i] <> least[i - 1]),
                         i -> named_struct('len', {SPAN}, 'at', i, 'key', least[i]))"""
    parts = [f"if(size(wh) < {SPAN}, cast(array() as array<struct<len:int,at:int,key:bigint>>), {kept})"]
    parts += [f"""if(size(wh) < {n}, cast(array() as array<struct<len:int,at:int,key:bigint>>),
                  transform(sequence(0, size(wh) - {n}), i -> named_struct('len', {n}, 'at', i, 'key', xxhash64(slice(wh, i + 1, {n})))))"""
              for n in short]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.struct("doc_id")
    rows = docs.select(row.alias("row"), "text").withColumn("uid", F.monotonically_increasing_id())
    per = (_hits if (size["b"] or 0) <= BROADCAST_BYTES else _far_hits)(rows, wins, parts)
    out = per.withColumn("spans", F.expr("array_sort(array_distinct(flatten(spans)))")).withColumn(
        "items", F.expr("array_sort(transform(array_distinct(flatten(items)), x -> string(x)))")).withColumn(
        # words covered: each span adds what lies beyond the furthest end so far (spans are sorted by start)
        "n_hit", F.expr("""aggregate(spans, named_struct('n', 0L, 'end', 0),
            (a, s) -> named_struct('n', a.n + greatest(0, s.start + s.len - greatest(a.end, s.start)),
                                   'end', greatest(a.end, s.start + s.len)), a -> a.n)"""))
    who = [F.col("row")] if carry else [F.col("row.doc_id").alias("doc_id")]
    return out.select(*who, "n_words", "n_hit", F.expr("bigint(size(items))").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items", "spans",
                      (F.col("n_hit") > 0).alias("contaminated"))
