"""Text jobs: shared phrases, hash embeddings, retrieval, quotes, section location, table regions."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config
from tidemark.functions import text as t
from tidemark.functions.exprs import rule_table
from tidemark.operators.phrases import added_up, counted, marked, packed
from tidemark.operators.search import retrieve, sparse, vector_top_k
from tidemark.session import staged



# ---- shared phrases ------------------------------------------------------------------------


def phrase_rows(texts: DataFrame, ids: Sequence[str], text: str, n: int = 8) -> DataFrame:
    """One row per shingle occurrence, with its words."""
    listed = texts.select(*ids, t.words(F.col(text)).alias("__words"))
    return listed.select(*ids, F.explode(t.shingles(F.col("__words"), n)).alias("phrase"))


def shingle_rows(texts: DataFrame, ids: Sequence[str], text: str, n: int = 8) -> DataFrame:
    """One row per shingle occurrence: the ids and the phrase's SHA-256."""
    return phrase_rows(texts, ids, text, n).select(*ids, t.digest(F.col("phrase")).alias("phrase_hash"))


def repeated_ids(texts: DataFrame, doc: str) -> DataFrame:
    """(__id) of the ids that more than one row has, as a table in the shared folder."""
    more = texts.groupBy(F.col(doc).alias("__id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return staged(more.select("__id"), "repeated-ids")


def shingle_counts(texts: DataFrame, doc: str, text: str, n: int = 8) -> DataFrame:
    """(doc, shingles, distinct_shingles, first_hash, last_hash) of every document with a shingle.

    A document in one row is counted in that row, so none of its shingles is shuffled. Only where several rows have
    the same id do their shingles come together by id and hash.
    """
    rows = texts.select(doc, F.col(text).alias("__text"))
    more = repeated_ids(rows, doc)
    same = F.col(doc).eqNullSafe(F.col("__id"))
    cut = rows.join(more, same, "left_anti").select(doc, t.words(F.col("__text")).alias("__words"))
    hashed = cut.select(doc, F.transform(t.shingles(F.col("__words"), n), lambda p: F.sha2(p, 256)).alias("__hashes"))
    figures = F.struct(
        F.size("__hashes").cast("long").alias("shingles"),
        F.size(F.array_distinct("__hashes")).cast("long").alias("distinct_shingles"),
        F.array_min("__hashes").alias("first_hash"),
        F.array_max("__hashes").alias("last_hash"),
    )
    # Not a filter: pushed below, it would cut the text into words anew for every shingle.
    once = hashed.select(doc, F.inline(F.when(F.size("__hashes") > 0, F.array(figures))))
    split = shingle_rows(rows.join(more, same, "left_semi"), [doc], "__text", n)
    per_phrase = split.groupBy(doc, "phrase_hash").agg(F.count(F.lit(1)).alias("n"))
    joined = per_phrase.groupBy(doc).agg(
        F.sum("n").alias("shingles"),
        F.count(F.lit(1)).alias("distinct_shingles"),
        F.lower(F.hex(F.min("phrase_hash"))).alias("first_hash"),
        F.lower(F.hex(F.max("phrase_hash"))).alias("last_hash"),
    )
    return once.unionByName(joined)


#: The key of a shingle, 16 bytes in two columns of fixed width, which hash aggregation keeps without sorting.
PHRASE_KEY = ["phrase_key", "phrase_key_more"]


def phrase_key(phrase: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds."""
    return [F.xxhash64(phrase).alias(PHRASE_KEY[0]), F.xxhash64(F.lit(1), phrase).alias(PHRASE_KEY[1])]


def distinct_phrases(texts: DataFrame, ids: Sequence[str], text: str, n: int = 8, several: bool = False) -> DataFrame:
    """Distinct shingle keys of every document (the first id) and company (the last), packed.

    There is about one shingle per word, so the size of its key is the size of the job. A block of many texts holds its
    keys in order: of the 96 bits of a key some 77 are left as a step from the key before, and the text is told by a number of
    a few bits. A row has the keys with the same first bits and is dealt by these alone; what counts or joins by the key after
    that needs no exchange of keys. One more row for a block, by its negative number, has its documents and their counts.

    Rows of repeated ids name the document beside the keys, since its keys meet by key only; with ``several`` all rows do.
    """
    doc, company = ids[0], ids[-1]
    kind = {field.name: field.dataType for field in texts.schema.fields}
    fields = {"phrase_key": T.LongType(), "block": T.LongType(), "phrases": T.BinaryType(), f"companies_{company}": T.ArrayType(kind[company])}
    fields |= {f"docs_{doc}": T.ArrayType(kind[doc]), "counts": T.ArrayType(T.LongType())}
    schema = T.StructType([T.StructField(*field) for field in fields.items()])
    rows = texts.select(doc, F.col(company).alias("__company"), F.lower(F.col(text)).alias("__text"))
    more = None if several else repeated_ids(texts, doc)
    prefix = (4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()  # a few groups for a partition

    def blocks(df: DataFrame, named: bool) -> DataFrame:
        # A task that runs again has to cut the same blocks: rows of a scan keep their order, those of an exchange are put in order.
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if not named and any(step in plan for step in ("Repartition", "Join", "Aggregate", "Window", "Distinct", "Rebalance")):
            df = df.sortWithinPartitions(doc, "__text")
        return df.mapInArrow(packed(n, prefix, named, schema), schema)

    if several or more.isEmpty():
        return blocks(rows, several).repartition("phrase_key")
    same = F.col(doc) == F.col("__id")
    parts = blocks(rows.join(more, same, "left_anti"), False), blocks(rows.join(more, same, "left_semi"), True)
    return parts[0].unionByName(parts[1]).repartition("phrase_key")


def phrase_companies(phrases: DataFrame, company: str, least: int = 1) -> DataFrame:
    """Distinct companies per shingle key with at least ``least``: the first bits, the key, the number."""
    assert f"companies_{company}" in phrases.columns
    schema = T.StructType([T.StructField(*f) for f in zip([*PHRASE_KEY, "company_count"], [T.LongType(), T.BinaryType(), T.LongType()], strict=True)])
    return phrases.groupBy("phrase_key").applyInArrow(counted(least, schema), schema)


def boilerplate(phrases: DataFrame, company: str, threshold: int = 3) -> DataFrame:
    """Shingles used by at least ``threshold`` companies."""
    return phrase_companies(phrases, company, threshold)


def shared_phrases(
    texts: DataFrame, ids: Sequence[str], company: str, text: str, threshold: int = 3, n: int = 8
) -> DataFrame:
    """(phrase_hash, phrase, company_count) of shingles used by at least ``threshold`` companies.

    One pass cuts the texts; every key carries a pointer, a number made of a hash of the text with its ids and of the
    place it stands at there. Rows of fixed width are dealt by the key alone, once. The pointers of shared keys go back to
    their texts as one list per text, which slices the words out there. Where texts have the same hash,
    the key tells the right one.
    """
    number = F.pmod(F.xxhash64(*ids, text), F.lit(1 << 32)).alias("__number")
    cut = texts.select(F.col(company).alias("__company"), number, t.words(F.col(text)).alias("__words"))
    rows = cut.select("__company", "__number", F.posexplode(t.shingles(F.col("__words"), n)).alias("at", "phrase"))
    pointer = (F.col("__number") * (1 << 31) + F.col("at")).alias("pointer")  # a place in an array has 31 bits
    rows = rows.select("__company", *phrase_key(F.col("phrase")), pointer).repartition(*PHRASE_KEY)
    per_company = rows.groupBy(*PHRASE_KEY, "__company").agg(F.min("pointer").alias("pointer"))
    shared = per_company.groupBy(*PHRASE_KEY).agg(F.count(F.lit(1)).alias("company_count"), F.min("pointer").alias("pointer"))
    shared = shared.where(F.col("company_count") >= threshold)
    place = F.struct(*PHRASE_KEY, "company_count", F.pmod("pointer", F.lit(1 << 31)).cast("int").alias("at"))
    lists = shared.groupBy(F.shiftright("pointer", 31).alias("__number")).agg(F.collect_list(place).alias("places"))
    found = texts.select(number, F.col(text).alias("__text")).join(lists, "__number")
    found = found.select("places", t.words(F.col("__text")).alias("__words"))
    sliced = lambda p: F.array_join(F.slice("__words", p["at"] + 1, n), " ").alias("phrase")
    found = found.select(F.explode(F.transform("places", lambda p: F.struct(p.alias("p"), sliced(p)))).alias("f")).select("f.p.*", "f.phrase")
    right = functools.reduce(operator.and_, [F.col(name) == key for name, key in zip(PHRASE_KEY, phrase_key(F.col("phrase")), strict=True)])
    found = found.where(right).dropDuplicates(PHRASE_KEY)
    return found.select(F.sha2("phrase", 256).alias("phrase_hash"), "phrase", "company_count")


def originality(phrases: DataFrame, docs: DataFrame, doc: str, shared: DataFrame) -> DataFrame:
    """Share of a document's distinct shingles that are not boilerplate; 1 without shingles.

    ``phrases`` are the :func:`distinct_phrases` by document, ``shared`` the :func:`boilerplate` among them: the first are
    dealt by key already, of the others a row for each group is. What comes back to a block is the numbers of texts, a few bits each.
    """
    kind = phrases.schema[f"docs_{doc}"].dataType
    told = {"phrase_key": T.LongType(), f"docs_{doc}": kind, "counts": T.ArrayType(T.LongType()), "hits": T.BinaryType()}
    told = T.StructType([T.StructField(*field) for field in told.items()])
    keys = shared.groupBy(PHRASE_KEY[0]).agg(F.collect_list(PHRASE_KEY[1]).alias("keys"))
    hits = phrases.groupBy("phrase_key").cogroup(keys.groupBy("phrase_key")).applyInArrow(marked(told), told)
    summed = T.StructType([T.StructField(doc, kind.elementType), *(T.StructField(name, T.LongType()) for name in ("phrase_count", "boilerplate_phrases"))])
    counts = hits.groupBy("phrase_key").applyInArrow(added_up(summed), summed)
    counts = counts.groupBy(doc).agg(*[F.sum(name).alias(name) for name in ("phrase_count", "boilerplate_phrases")])
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return (
        docs.select(doc)
        .distinct()
        .join(counts, doc, "left")
        .select(doc, zero("phrase_count"), zero("boilerplate_phrases"))
        .withColumn("originality", 1 - F.col("boilerplate_phrases") / F.greatest(F.lit(1), F.col("phrase_count")))
    )


# ---- signed hash embeddings ----------------------------------------------------------------


def packed_vectors(texts: DataFrame, doc: str, text: str, dimensions: int = 1024) -> DataFrame:
    """The vectors of :func:`hash_vectors` in one row each: (doc, vector, norm2), vector a list of (index, weight) by index.

    A document in one row is counted in that row, as runs of equal index in its sorted tokens: a task holds no table
    of documents, however many it reads, and nothing is shuffled. Only where several rows have the same id
    are their tokens counted by id and index.
    """
    # The first ten digits of a token's hash: four bytes for the index, one for the sign.
    number = F.transform(t.tokens(F.col("__text")), lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 10), 16, 10).cast("long"))
    code = F.transform(number, lambda h: F.shiftright(h, 8) % dimensions * 2 + h.bitwiseAND(1))
    codes = F.coalesce(F.array_sort(code), F.array().cast("array<bigint>")).alias("__codes")
    rows = texts.select(doc, F.col(text).alias("__text"))
    more = repeated_ids(rows, doc)
    same = F.col(doc).eqNullSafe(F.col("__id"))
    # Steps are columns of their own: an expression would be worked out again for every token.
    once = rows.join(more, same, "left_anti").select(doc, codes)
    size = F.size("__codes")
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    index = lambda place: F.shiftright(F.get("__codes", place), 1)
    begins = F.filter(places, lambda i: (i == 0) | (index(i) != index(i - 1)))
    once = once.select(doc, "__codes", begins.alias("__begins"))

    def entry(begin: Column, run: Column) -> Column:
        end = F.coalesce(F.get("__begins", run + 1), size)
        signs = F.slice("__codes", begin + 1, end - begin)
        weight = F.aggregate(signs, F.lit(0).cast("long"), lambda total, c: total + 1 - c.bitwiseAND(1) * 2)
        return F.struct(index(begin).cast("int").alias("index"), weight.alias("weight"))

    once = once.select(doc, F.filter(F.transform("__begins", entry), lambda e: e["weight"] != 0).alias("vector"))
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda total, e: total + e["weight"] * e["weight"])
    figures = F.struct("vector", square.alias("norm2"))
    # Not a filter, which would be pushed below and work out the vector twice.
    once = once.select(doc, F.inline(F.when(F.size("vector") > 0, F.array(figures))))
    split = rows.join(more, same, "left_semi").select(doc, F.explode(code).alias("__code"))
    counted = (
        split.groupBy(doc, F.shiftright("__code", 1).cast("int").alias("index"))
        .agg(F.sum(1 - F.col("__code").bitwiseAND(1) * 2).alias("weight"))
        .where(F.col("weight") != 0)
    )
    # A document has at most ``dimensions`` entries.
    joined = counted.groupBy(doc).agg(
        F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("vector"), F.sum(F.col("weight") * F.col("weight")).alias("norm2")
    )
    return once.unionByName(joined)


def hash_vectors(texts: DataFrame, doc: str, text: str, dimensions: int = 1024) -> DataFrame:
    """Sparse signed hash embedding: (doc, index, weight, norm2) with whole-number weights.

    A token's hash gives its index (first four bytes) and sign (lowest bit of the fifth). The
    L2-normalised value is ``weight / sqrt(norm2)``; keeping whole numbers makes sums exact.
    """
    rows = packed_vectors(texts, doc, text, dimensions)
    return rows.select(doc, "norm2", F.inline("vector")).select(doc, "index", "weight", "norm2")


def seed_similarity(seeds: DataFrame, texts: DataFrame, seed: str, doc: str) -> DataFrame:
    """Dot product of normalised sparse vectors for every text and the few seeds that share an index."""
    left = seeds.select(seed, "index", F.col("weight").alias("q_weight"), F.col("norm2").alias("q_norm2"))
    both = texts.join(F.broadcast(left), "index")  # configuration
    dots = both.groupBy(seed, doc, "norm2", "q_norm2").agg(F.sum(F.col("weight") * F.col("q_weight")).alias("dot"))
    return dots.select(
        seed, doc, (F.col("dot") / (F.sqrt(F.col("norm2").cast("double")) * F.sqrt(F.col("q_norm2").cast("double")))).alias("similarity")
    )


def rank_texts(
    queries: DataFrame, pages: DataFrame, query: str, page: str, text: str, k: int, dimensions: int = 1024
) -> DataFrame:
    """Top pages per query text by embedding similarity; ties by page.

    A page counts for a query if they share an index. See ``vector_top_k``.
    """

    def packed(texts: DataFrame, doc: str) -> DataFrame:
        entries = F.transform("vector", lambda e: e["weight"] * dimensions + e["index"])
        return packed_vectors(texts, doc, text, dimensions).select(doc, entries.alias("vector"))

    held = staged(packed(pages, page), "page-vectors")  # read for the pivots and for the search
    scored = vector_top_k(packed(queries, query), held, query, page, "vector", k, sparse(dimensions), shared=True)
    return scored.withColumnRenamed("score", "similarity")


def themes(texts: DataFrame, doc: str, text: str, seeds: dict[str, str] | None = None) -> DataFrame:
    """Theme per text: most similar seed, the earlier seed on a tie, 'other' without a positive one."""
    seeds = seeds or config.THEME_SEEDS
    rows = [(number, label, words) for number, (label, words) in enumerate(seeds.items())]
    table = rule_table(texts.sparkSession, ["seed", "theme", "words"], rows)
    seed_vectors = hash_vectors(table, "seed", "words", 256)
    scored = seed_similarity(seed_vectors, hash_vectors(texts, doc, text, 256), "seed", doc)
    best = scored.groupBy(doc).agg(
        F.max_by("seed", F.struct(F.round("similarity", 9), -F.col("seed"))).alias("seed"),
        F.max("similarity").alias("similarity"),
    )
    named = best.where(F.col("similarity") > 0).join(F.broadcast(table.select("seed", "theme")), "seed")
    return (
        texts.select(doc)
        .join(named.select(doc, "theme"), doc, "left")
        .withColumn("theme", F.coalesce("theme", F.lit(config.THEME_OTHER)))
    )


# ---- retrieval -----------------------------------------------------------------------------


def propose_fields(fields: DataFrame, pages: DataFrame, answered: DataFrame) -> DataFrame:
    """Best evidence page per unanswered field and the value it offers, with the field's unit.

    ``fields``: query_id, org, label, field_key, dtype, unit. Pages are searched with label and key.
    Confidence is 0.7 plus the score, at most 0.98.
    """
    open_fields = fields.join(answered.select("query_id"), "query_id", "left_anti")
    evidence = retrieve(open_fields.withColumn("query", F.concat_ws(" ", "label", "field_key")), pages, k=1)
    rows = evidence.join(open_fields.select("query_id", "field_key", "dtype", "unit"), "query_id").join(
        pages.select("page_id", "text"), "page_id"
    )
    quote = F.trim(F.substring("text", 1, 280))
    proposals = rows.select(
        "query_id",
        "field_key",
        "unit",
        "page_id",
        t.candidate_value(F.col("dtype"), F.col("text")).alias("value"),
        quote.alias("quote"),
        F.least(F.lit(0.98), F.lit(0.7) + F.col("score")).alias("confidence"),
        F.lit("unreviewed").alias("review_status"),
    )
    return proposals.where(F.col("value").isNotNull() & (quote != ""))


def evidence_gaps(field_defs: DataFrame, evidenced: DataFrame) -> DataFrame:
    """Principles without a single evidenced field."""
    hit = evidenced.select("field_key").distinct().withColumn("hit", F.lit(1))
    return (
        field_defs.join(hit, "field_key", "left")
        .groupBy("principle")
        .agg(F.count(F.lit(1)).alias("fields"), F.count("hit").alias("covered"))
        .where(F.col("covered") == 0)
        .drop("covered")
    )


# ---- verbatim quotes -----------------------------------------------------------------------

#: Quotes, and characters of quotes, that go to the tasks at once; characters of a quote in the automaton.
QUOTE_BLOCK, QUOTE_CHARS, QUOTE_HEAD = 20_000, 4_000_000, 24


def _quote_finder(held: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Made by a factory so that workers get it by value."""
    head = QUOTE_HEAD

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        quotes = held.value
        by_head: dict[str, list[int]] = {}
        for k, (_, quote) in enumerate(quotes):
            by_head.setdefault(quote[:head], []).append(k)
        automaton = ahocorasick.Automaton()
        for start, those in by_head.items():
            automaton.add_word(start, (len(start), those))
        automaton.make_automaton()
        for pdf in batches:
            rows = []
            for page, text in zip(pdf["page_id"], pdf["text"], strict=True):
                there: set[int] = set()
                for end, (size, those) in automaton.iter(text):
                    there.update(k for k in those if k not in there and text.startswith(quotes[k][1], end - size + 1))
                rows += [(quotes[k][0], page) for k in there]
            yield pd.DataFrame(rows, columns=["quote_id", "page_id"])

    return find


def find_quotes(quotes: DataFrame, pages: DataFrame, block: int = QUOTE_BLOCK, chars: int = QUOTE_CHARS) -> DataFrame:
    """(quote_id, page_id) for every page that has the normalised quote word for word.

    Quotes go to the tasks in blocks of about ``block`` quotes and ``chars`` characters, which all pages pass in a map: an
    automaton over the heads of the quotes (Aho-Corasick) reads a page once, whatever the number of
    quotes, and a quote is compared in full where its head stands. No page is shuffled.
    """
    spark = quotes.sparkSession
    listed = quotes.select("quote_id", t.normalised(F.col("quote")).alias("q")).where(F.col("q") != "")
    normal = pages.select("page_id", t.normalised(F.col("text")).alias("text")).where(F.col("text") != "")
    schema = T.StructType([quotes.schema["quote_id"], pages.schema["page_id"]])
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("q")), F.lit(0)).alias("chars")).first()
    number = max(-(-size["n"] // block), -(-size["chars"] // chars))
    found = spark.createDataFrame([], schema)
    for part in range(number):
        rows = listed.where(F.pmod(F.xxhash64("quote_id", "q"), F.lit(number)) == part).collect()  # a block
        if rows:
            finder = _quote_finder(spark.sparkContext.broadcast([(r["quote_id"], r["q"]) for r in rows]))
            some = normal.mapInPandas(finder, schema)
            found = some if part == 0 else found.unionByName(some)
    return found


# ---- sections and tables -------------------------------------------------------------------

CARRY_BLOCK = 65_536


def carry_forward(df: DataFrame, keys: Sequence[str], position: str, value: str, out: str) -> DataFrame:
    """Last non-null value up to each row's position within its keys.

    Two levels, so that one very long document is spread: rows within blocks of positions, then
    one row per block.
    """
    blocked = df.withColumn("__block", F.floor(F.col(position) / CARRY_BLOCK))
    last = (
        blocked.where(F.col(value).isNotNull())
        .groupBy(*keys, "__block")
        .agg(F.max_by(value, position).alias("__last"))
    )
    blocks = blocked.select(*keys, "__block").distinct().join(last, [*keys, "__block"], "left")
    before = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).drop("__last")
    inside = W.partitionBy(*keys, "__block").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return (
        blocked.withColumn("__here", F.last(value, ignorenulls=True).over(inside))
        .join(blocks, [*keys, "__block"])
        .withColumn(out, F.coalesce("__here", "__carried"))
        .drop("__block", "__here", "__carried")
    )


def anchor_scorer(anchors: dict[str, tuple[str, ...]]) -> Callable[[list[str], float], np.ndarray]:
    """Function from page texts to one score per section: 1 for an exact heading, else line likeness.

    Likeness is the sequence-matcher ratio of the heading and the start of a line (lines end at a
    full stop). The blocks it counts are a common subsequence, so a ratio is at most twice the longest
    common subsequence over the letters of both. That is worked out for all lines at once, a heading as the bits of a
    word (Hyyrö); only lines that could exceed ``floor`` and what their page has already are compared, the
    most promising first. Made by a factory so that workers get it by value.
    """
    letters = "".join(sorted({letter for options in anchors.values() for a in options for letter in a}))
    longest = max(len(a) for options in anchors.values() for a in options) + 20

    def score(texts: list[str], floor: float) -> np.ndarray:
        from difflib import SequenceMatcher

        normal = [" ".join(text.lower().split()) for text in texts]
        out = np.zeros((len(texts), len(anchors)))
        lines: list[str] = []
        owner: list[int] = []
        for number, text in enumerate(normal):
            parts = text.split(".")
            lines += [part[:longest] for part in parts]
            owner += [number] * len(parts)
        size = np.array([len(line) for line in lines])
        # Code points outside the headings' letters can never match; they share one code.
        table = np.full(0x110000, len(letters), dtype=np.uint8)
        for code, letter in enumerate(letters):
            table[ord(letter)] = code
        padded = np.array(lines, dtype=f"U{longest}").view(np.uint32).reshape(len(lines), longest)
        codes = np.ascontiguousarray(table[padded].T)  # a row per place in the line

        def common(part: str, width: int) -> np.ndarray:
            """Length of the longest common subsequence of at most 64 letters with the start of every line."""
            at = np.zeros(len(letters) + 1, dtype=np.uint64)
            for place, letter in enumerate(part):
                at[letters.index(letter)] |= np.uint64(1 << place)
            rest = np.full(len(lines), np.iinfo(np.uint64).max, dtype=np.uint64)
            for row in codes[:width]:
                met = rest & at[row]
                rest = (rest + met) | (rest - met)
            return np.bitwise_count(~rest & np.uint64((1 << len(part)) - 1)).astype(np.int64)

        for section, options in enumerate(anchors.values()):
            exact = np.array([any(anchor in text for anchor in options) for text in normal], dtype=bool)
            out[exact, section] = 1.0
            bounds = np.zeros((len(options), len(lines)))
            for number, anchor in enumerate(options):
                width = len(anchor) + 20
                letters_met = sum(common(anchor[low : low + 64], width) for low in range(0, len(anchor), 64))
                bounds[number] = 2.0 * letters_met / (len(anchor) + np.minimum(size, width))
            bounds[:, exact[owner]] = 0.0
            option, line = np.nonzero(bounds > floor)
            likely = bounds[option, line]
            matcher = SequenceMatcher(None, "", "")
            for k in np.argsort(-likely, kind="stable"):
                page = owner[line[k]]
                if likely[k] > out[page, section]:
                    anchor = options[option[k]]
                    matcher.set_seqs(anchor, lines[line[k]][: len(anchor) + 20])
                    out[page, section] = max(out[page, section], matcher.ratio())
        return out

    return score


SECTION_LIMIT = 0.72


def section_scores(pages: DataFrame, anchors: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Pages with their likeness to every section heading, computed page by page in Arrow batches.

    Pages that hold a title or an exact heading are scored in full; for all others only values
    above the section limit can matter, so lower ones are not worked out and show as 0.
    """
    anchors = anchors or config.SECTION_ANCHORS
    likeness_of = anchor_scorer(anchors)
    title, first = config.SECTION_TITLE, list(anchors).index("a")
    limit = SECTION_LIMIT

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            rows: list[list[float]] = []
            texts: list[str] = []
            size = 0
            for number, text in enumerate(series):
                texts.append(text or "")
                size += len(texts[-1])
                # Pages are scored together up to a number of characters, which bounds memory.
                if size < 1_000_000 and number + 1 < len(series):
                    continue
                found = likeness_of(texts, limit - 1e-9)
                whole = [
                    i
                    for i, page in enumerate(texts)
                    if found[i, first] >= limit or title in " ".join(page.lower().split())
                ]
                if whole:
                    found[whole] = likeness_of([texts[i] for i in whole], 0.0)
                rows += found.tolist()
                texts, size = [], 0
            yield pd.Series(rows)

    likeness = F.pandas_udf(score, T.ArrayType(T.DoubleType()), F.PandasUDFType.SCALAR_ITER)
    return pages.withColumn("scores", likeness(F.col("text")))


def locate_sections(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(start, page_sections) of the report inside each filing's pages.

    ``pages``: filing_id, page_no, text. Start is the page that looks most like the opening; it is
    ambiguous when the runner-up comes within 0.08. From the start on, a page takes the section it
    looks like, or else the section of the page before.
    """
    anchors = list(config.SECTION_ANCHORS)
    at = {key: F.element_at("scores", number + 1) for number, key in enumerate(anchors)}
    title = F.regexp_replace(F.lower("text"), r"(?U)\s+", " ").contains(config.SECTION_TITLE)
    scored = section_scores(pages).select("filing_id", "page_no", "scores", title.alias("title"))
    scored = staged(scored, "section-scores")  # Python work is done once for all uses below
    principle = F.greatest(*[at[key] for key in anchors if key.startswith("p")])
    opening = F.least(
        F.lit(1.0), F.when(F.col("title"), 0.55).otherwise(0.0) + at["a"] * 0.60 + principle * 0.10
    )
    options = scored.where((at["a"] >= SECTION_LIMIT) | F.col("title")).select(
        "filing_id", "page_no", opening.alias("score")
    )
    top = W.partitionBy("filing_id").orderBy(F.desc("score"), F.desc("page_no"))
    two = options.withColumn("place", F.row_number().over(top)).where(F.col("place") <= 2)
    start = two.groupBy("filing_id").agg(
        F.max(F.when(F.col("place") == 1, F.col("page_no"))).alias("start_page"),
        F.max(F.when(F.col("place") == 1, F.col("score"))).alias("opening"),
        F.max(F.when(F.col("place") == 2, F.col("score"))).alias("runner_up"),
    )
    best = F.greatest(*[F.struct(at[key].alias("score"), F.lit(key).alias("key")) for key in anchors])
    hits = scored.select(
        "filing_id", "page_no", F.when(best["score"] >= SECTION_LIMIT, best["key"]).alias("hit")
    )
    inside = hits.join(start.select("filing_id", "start_page"), "filing_id").where(
        F.col("page_no") >= F.col("start_page")
    )
    sections = (
        carry_forward(inside, ["filing_id"], "page_no", "hit", "section")
        .where(F.col("section").isNotNull())
        .select("filing_id", "page_no", "section")
    )
    found = inside.groupBy("filing_id").agg(F.count("hit").alias("hits"))
    ends = pages.groupBy("filing_id").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("end_page"))
    likely = F.col("opening") * 0.7 + F.least(F.lit(1.0), F.col("hits") / 5) * 0.3
    located = ends.join(start, "filing_id", "left").join(found, "filing_id", "left")
    return (
        located.select(
            "filing_id",
            F.coalesce("start_page", "first_page").alias("start_page"),
            "end_page",
            F.coalesce(F.bround(likely, 4), F.lit(0.0)).alias("confidence"),
            F.when(F.col("start_page").isNull(), True)
            .otherwise(F.coalesce(F.col("runner_up") >= F.col("opening") - 0.08, F.lit(False)))
            .alias("ambiguous"),
        ),
        sections,
    )


def table_regions(words: DataFrame) -> DataFrame:
    """Dense aligned areas of a page: rows of three or more words, two rows, three columns.

    ``words``: page_id, x0, y0, x1, y1. Words are counted per (row, column) cell first, so a
    crowded page is combined on the map side.
    """
    cells = words.groupBy(
        "page_id", F.rint(F.col("y0") / 5).alias("row"), F.rint(F.col("x0") / 12).alias("col")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
    )
    rows = cells.groupBy("page_id", "row").agg(F.sum("n").alias("row_words")).where(F.col("row_words") >= 3)
    page_words = cells.groupBy("page_id").agg(F.sum("n").alias("words"))
    aligned = cells.join(rows, ["page_id", "row"])
    box = aligned.groupBy("page_id").agg(
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.count_distinct("row").alias("rows"),
        F.count_distinct("col").alias("columns"),
    )
    enough = (F.col("rows") >= 2) & (F.col("columns") >= 3) & (F.col("words") >= 8)
    return box.join(page_words, "page_id").where(enough).drop("words")


def high_score_pages(
    queries: DataFrame, pages: DataFrame, scores: DataFrame, threshold: float, k: int = 5, excerpt: int = 500
) -> DataFrame:
    """Best pages per query among those of company-years with a high substance score.

    All eligible pages are ranked. ``pages``: page_id, company_id, fy, text.
    """
    newest = scores.agg(F.max("method_version")).scalar()
    good = scores.where(
        (F.col("score_key") == "substance") & (F.col("method_version") == newest) & (F.col("value") >= threshold)
    )
    eligible = pages.join(good.select("company_id", "fy"), ["company_id", "fy"], "left_semi")
    ranked = rank_texts(queries, eligible, "query_id", "page_id", "text", k)
    return ranked.join(
        eligible.select("page_id", F.substring("text", 1, excerpt).alias("excerpt"), "fy"), "page_id"
    )
