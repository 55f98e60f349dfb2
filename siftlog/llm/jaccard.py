"""Jaccard join of word n-grams by prefix filters under several global orders.

A document is its set of distinct n-grams.  Two sets with similarity t or more share a token among the first
n - ceil(t n) + 1 of either one, whatever global order the tokens stand in.  So candidates have to share a
prefix token in each of several orders, and only what passes all of them is verified.

Each order puts other tokens first (``ORDERS``, by the hash): a quarter of them, the other three quarters, and all;
among these the tokens of fewest sets come first.  The first order is taken over all sets, each further one over the
sets that share a prefix token in the orders before it, so its counts are other counts and its prefixes other
tokens.  A set whose prefix is unique to it ends there.  The last order, over whole sets, makes the pairs; a pair
must meet in the prefixes of the other orders too before its sets are fetched.  Very common tokens, held by over
``COMMON`` of the sets, stand behind the others of their class and are sent only where a prefix reaches them; they
are dealt out with a salt.

Equal sets are one set from the start.  The sets that share a prefix token are not paired with one another: a
leader of the token, the set with fewest tokens of its own, is compared with the rest, and everything linked becomes
one component.  Tokens of up to ``LEADERS`` sets pair what still lies in several components.  For the others the sets
are seen as what they differ in from their leader: the leader's tokens they lack and the tokens it lacks.  Two sets
differ where exactly one of them differs from the leader.  So two that link, but are not both linked to the leader,
differ from it in common tokens, in the more the further off they are, and the prefix filter is applied to these
differences, rarest first.  In a group of near copies almost nothing passes that.  Every two sets of a token are thus
compared, in one component or known to be too far apart, so the components are exact.
Tokens and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlog.llm.columns import map_batches, slices
from siftlog.llm.components import connected_components
from siftlog.session import written

COMMON = 0.002  # share of documents
MOST_COMMON = 100_000  # common tokens that are known to all tasks (0.8 MB); the most frequent ones
SALTS = 64
BITS = 2_048  # of a set's map: its elements' hashes; bits that only one of two sets has are elements that only it has
LEADERS = 8  # sets of a token that are all paired with one another
MOST_BROADCAST = 200_000  # pairs of 16 bytes that may be broadcast; more are joined by shuffling
TOKENS = 200_000  # that a task lays out at once, some 16 MB
KNOWN_WORDS = 200_000  # hashes of words a worker keeps
QUARTER = 1 << 62  # tokens below have unsigned hashes with two leading zero bits
ORDERS = ("quarter", "others", "all")  # the tokens that each order puts first
HOT = 1_000  # a token with more than this many sets and this share (1 / HOT) of all entries is dealt out in SALTS parts


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def shingles(text: str | None, words: int):
    """Sorted distinct 64-bit hashes of the n-grams; a shorter text is one n-gram; none without words."""
    import numpy as np

    # bytes: lower() takes A-Z only, split() the six ASCII white spaces
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    out = np.full(len(parts) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out + codes[i:len(codes) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def set_key(found) -> int:
    import numpy as np
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), len(found))).view(np.int64))


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _first(tokens, order: str):
    """Which tokens (signed) the order puts first."""
    quarter = (tokens >= 0) & (tokens < QUARTER)
    return quarter if order == "quarter" else ~quarter if order == "others" else quarter | True


def _sets(percent: int, words: int):
    """(id, text, ...) -> id, n, set_id and the tokens that may stand in the first order's prefix: the quarter, or more where it is too small; and the rest."""
    def make(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1):
                sizes, keys, tokens = [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, words)
                    sizes.append(len(found))
                    keys.append(set_key(found))
                    first = int(np.searchsorted(found, np.uint64(QUARTER)))
                    tokens.append(found[:max(first, prefix_length(len(found), percent) if len(found) else 0)])
                ends = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum([len(t) for t in tokens], out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), lists, *part.columns[2:]],
                    names=["id", "n", "set_id", "tokens", *part.schema.names[2:]])

    return make


def _frequent(order: str):
    """Tokens of a batch that are common in it, with their sets; every set is counted."""
    def make(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            flat = np.asarray(batch.column(0).flatten())
            token, count = np.unique(flat[_first(flat, order)], return_counts=True)
            keep = (count > 1) & (count >= COMMON / 2 * batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(count[keep].astype(np.int64))], names=["token", "docs"])

    return make


def _parts(batch):
    """The batch (n, set_id, tokens) in slices of about ``TOKENS`` tokens, at least one set each."""
    import numpy as np

    ends = np.cumsum(np.asarray(batch.column(2).value_lengths()), dtype=np.int64) // TOKENS
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def _entries(percent: int, order: str, common):
    """(n, set_id, tokens) -> a row for each token sent: set_id, its number of plain tokens, and the token's salt.

    Salt -1 marks plain tokens that the order puts first, -2 others; common tokens have 0 and more.
    """
    def make(batches):
        import numpy as np
        import pyarrow as pa

        def before(mask, starts, row):
            """Of each token, the marked ones before it in its set."""
            upto = np.concatenate([[0], np.cumsum(mask)])
            return upto[:-1] - upto[starts[row]]

        known = common.value
        for batch in (part for b in batches for part in _parts(b)):
            n, key = (np.asarray(batch.column(i)) for i in (0, 1))
            lengths = np.asarray(batch.column(2).value_lengths())
            flat = np.asarray(batch.column(2).flatten())
            row, starts = np.repeat(np.arange(len(n)), lengths), np.cumsum(lengths) - lengths
            first = _first(flat, order)
            is_common = np.isin(flat, known) & first
            # common tokens are sent only where the plain ones do not fill the prefix, others where both do not
            plain = np.bincount(row[first & ~is_common], minlength=len(n))
            room = np.maximum(0, prefix_length(n, percent) - plain)
            after = np.maximum(0, room - np.bincount(row[is_common], minlength=len(n)))
            keep = np.where(first, ~is_common | (before(is_common, starts, row) < room[row]), before(~first, starts, row) < after[row])
            row, token, first, is_common = row[keep], flat[keep], first[keep], is_common[keep]
            salt = np.where(is_common, key[row] % SALTS, np.where(first, -1, -2)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(key[row]), pa.array(plain[row].astype(np.int32)), pa.array(salt)],
                names=["token", "set_id", "plain", "salt"])

    return make


def _full(words: int):
    """(set_id, text) -> set_id, shingles and their map, for texts that are that set (another text may have the same id)."""
    def make(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1):
                found = [shingles(t, words) for t in part.column(1).to_pylist()]
                same = [i for i, (key, f) in enumerate(zip(part.column(0).to_pylist(), found, strict=True)) if set_key(f) == key]
                found = [found[i] for i in same]
                ends = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(t) for t in found], out=ends[1:])
                flat = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                maps = np.zeros((len(found), BITS), np.uint8)
                for m, f in zip(maps, found, strict=True):
                    m[(f % np.uint64(BITS)).astype(np.int64)] = 1
                maps = np.packbits(maps, axis=1).view(np.int64).reshape(len(found), BITS // 64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(same, pa.int64())), lists, pa.array(list(maps), pa.list_(pa.int64()))],
                    names=["set_id", "shingles", "bits"])

    return make


def _shared_tokens(sets: DataFrame, percent: int, order: str) -> DataFrame:
    """(set_id, u, shared): of each set (n, set_id, tokens) the tokens that another one also sent, and how many plain tokens only it has."""
    import numpy as np

    total = sets.count()
    frequent = map_batches(sets.select("tokens"), _frequent(order), "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs"))
    rows = frequent.filter(F.col("docs") >= max(16, COMMON * total / 2)).orderBy(F.desc("docs"), "token").limit(MOST_COMMON).collect()
    common = sets.sparkSession.sparkContext.broadcast(np.array(sorted(r.token for r in rows), np.int64))
    entries = map_batches(
        sets.select("n", "set_id", "tokens"), _entries(percent, order, common), "token long, set_id long, plain int, salt int")
    # one shuffle of the entries: counted where they meet, and only those that may be shared go on
    same = Window.partitionBy("token", "salt")
    counted = entries.withColumns({
        "docs": F.count(F.lit(1)).over(same), "low": F.min("set_id").over(same), "high": F.max("set_id").over(same)})
    counted = written(sets.sparkSession, counted.filter("salt >= 0 or low <> high").dropDuplicates(["token", "salt", "set_id"]), "shared")
    salted = counted.filter("salt >= 0")
    whole = salted.groupBy("token", "salt").agg(*(F.first(c).alias(c) for c in ("docs", "low", "high"))).groupBy("token").agg(
        F.sum("docs").alias("docs"), F.min("low").alias("low"), F.max("high").alias("high"))
    # common tokens: at most MOST_COMMON rows
    found = counted.filter("salt < 0").select("token", "set_id", "plain", "salt", "docs").unionByName(
        salted.drop("docs", "low", "high").join(F.broadcast(whole.filter("low <> high").select("token", "docs")), "token"))
    kind = F.least(F.col("salt"), F.lit(0))
    of_set = found.groupBy("set_id").agg(F.max("plain").alias("plain"), F.collect_list(F.struct(kind.alias("kind"), "docs", "token")).alias("shared"))
    own = F.col("plain") - F.size(F.filter("shared", lambda x: x.kind == -1))
    return of_set.select("set_id", own.alias("u"), "shared")


def _prefix(shared: Column, u: Column, n: Column, percent: int) -> Column:
    """The shared tokens of a set's prefix; common tokens and those the order puts last were sent only where it needs them."""
    room = F.greatest(F.lit(0), prefix_length_column(n, percent) - u).cast("int")
    plain = F.transform(F.filter(shared, lambda x: x.kind == -1), lambda x: F.struct(x.docs.alias("docs"), x.token.alias("token")))
    rest = F.filter(shared, lambda x: x.kind != -1)
    return F.concat(F.transform(F.slice(F.array_sort(plain), F.lit(1), room), lambda x: x.token), F.transform(rest, lambda x: x.token))


def _reached(sets: DataFrame, percent: int, order: str, prefix: str) -> DataFrame:
    """(set_id, n, u, prefix) of the sets (n, set_id, tokens) that share a token of their prefix with another one."""
    u, n = F.col("u"), F.col("n")
    shared = _shared_tokens(sets, percent, order).join(sets.select("set_id", "n"), "set_id").filter(u < prefix_length_column(n, percent))
    reached = shared.select("set_id", "n", "u", _prefix(F.col("shared"), u, n, percent).alias(prefix))
    return written(sets.sparkSession, reached.filter(F.size(prefix) > 0), "reached")


def prefix_length_column(n: Column, percent: int) -> Column:
    return n - F.floor((percent * n + 99) / 100) + 1


def _alike(size_a: Column, size_b: Column, percent: int) -> Column:
    return 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``df``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  Two rows link when the similarity of their sets of
    ``words``-grams is at least ``percent`` hundredths; ``component_id`` is the smallest id that links lead to, the
    row's own included.  Null and empty texts have no n-grams and link with nothing; equal rows link with each other.
    """
    of_doc = groups(df, doc_id, text, words, percent)
    least = of_doc.filter("n > 0").groupBy("group").agg(F.min("id").alias("least"))
    placed = of_doc.join(least, "group", "left")
    return placed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """(id, n, set_id, text_hash, group), a row for each row of ``df``: rows with n-grams that links join share a group.

    ``text_hash``, xxhash64 of the text, tells rows apart where ids are repeated or null.
    """
    spark = df.sparkSession
    rows = df.select(df[doc_id].cast("long").alias("id"), df[text].alias("text"), F.xxhash64(df[text]).alias("text_hash"))
    sets = written(spark, map_batches(rows, _sets(percent, words), "id long, n long, set_id long, tokens array<long>, text_hash long"), "sets")
    used = sets.filter("n > 0")

    # the first order, over all sets
    reached = _reached(used.select("n", "set_id", "tokens"), percent, ORDERS[0], "p0").dropDuplicates(["set_id"])

    # the whole sets that are left, from one document each
    holders = used.groupBy("set_id").agg(F.min(F.struct("text_hash", "id")).alias("holder")).join(reached, "set_id").select(
        F.col("holder.text_hash").alias("of_hash"), F.col("holder.id").alias("of_id"), "set_id")
    texts = rows.join(holders, (F.col("text_hash") == F.col("of_hash")) & F.col("id").eqNullSafe(F.col("of_id"))).select("set_id", "text")
    full = map_batches(texts, _full(words), "set_id long, shingles array<long>, bits array<long>").dropDuplicates(["set_id"])
    whole = written(spark, full, "shingles")

    # the further orders, each over the sets that the ones before it left
    chosen = reached.select("set_id", "n", "p0")
    for k, order in enumerate(ORDERS[1:], 1):
        left = whole.select("set_id", F.col("shingles").alias("tokens")).join(chosen.select("set_id", "n"), "set_id")
        chosen = chosen.drop("u").join(_reached(left.select("n", "set_id", "tokens"), percent, order, f"p{k}").drop("n"), "set_id")
    chosen = written(spark, chosen, "chosen")

    last = len(ORDERS) - 1
    entries = chosen.select("set_id", "n", "u", F.explode(f"p{last}").alias("token"))
    filters = written(spark, chosen.select("set_id", "n", *(f"p{k}" for k in range(last))).join(whole.select("set_id", "bits"), "set_id"), "filters")
    roots = connected_components(_links(spark, entries, filters, whole.select("set_id", "shingles"), percent))
    return sets.drop("tokens").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "group", F.coalesce("root", "set_id"))


def _dealt(entries: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Entries with the other rows of their keys; keys of very many entries are dealt out (there are fewer than ``HOT``)."""
    hot = F.broadcast(entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("sets")).filter(
        F.col("sets") > max(HOT, entries.count() // HOT)).select(*keys, F.lit(SALTS).alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    one = entries.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64("set_id"), salts).cast("int")).drop("salts")
    other = others.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return one.join(other, [*keys, "salt"])


def _pairs() -> list[Column]:
    return [F.least("set_id", "l_set_id").alias("a"), F.greatest("set_id", "l_set_id").alias("b")]


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """Rows of the keys whose sets lie in several components."""
    keys = rows.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return rows.join(keys.select(key), key, "left_semi")


def _links(spark, entries: DataFrame, filters: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all sets of a component; not every link within one."""
    heads = entries.groupBy("token").agg(F.min(F.struct("u", "n", "set_id")).alias("leader"), F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    heads = written(spark, heads.select("token", "sets", F.col("leader.set_id").alias("l_set_id"), F.col("leader.n").alias("l_n")), "heads")
    entries = written(spark, entries.drop("u").join(heads.select("token"), "token", "left_semi"), "entries")
    met = written(spark, _dealt(entries, heads, ["token"]).filter("set_id <> l_set_id").select(
        "set_id", "n", "l_set_id", "l_n", (F.col("sets") <= LEADERS).alias("few")).groupBy("set_id", "n", "l_set_id", "l_n").agg(
        F.bool_and("few").alias("few")), "met")
    done = written(spark, met.filter(_alike(F.col("n"), F.col("l_n"), percent)).select(*_pairs()).distinct(), "pairs")
    links = _verified(done, filters, whole, percent)
    labels = written(spark, connected_components(links).select(F.col("node").alias("set_id"), "root"), "labels")

    def labelled(rows):
        return rows.join(labels, "set_id", "left").withColumn("label", F.coalesce("root", "set_id")).drop("root")

    few = written(spark, _mixed(labelled(entries.join(heads.filter(F.col("sets") <= LEADERS).select("token"), "token", "left_semi")), "token"), "few")
    others = few.select("token", *(F.col(c).alias(f"l_{c}") for c in ("set_id", "n", "label")))
    near = few.join(others, "token").filter(
        (F.col("set_id") < F.col("l_set_id")) & (F.col("label") != F.col("l_label")) & _alike(F.col("n"), F.col("l_n"), percent)).select(*_pairs())
    many = _mixed(labelled(met.filter("not few").select("set_id", "n", F.col("l_set_id").alias("leader"))), "leader")
    pairs = near.unionByName(_differing(spark, many, whole, percent)).distinct().join(done, ["a", "b"], "left_anti")
    return links.unionByName(_verified(written(spark, pairs, "pairs"), filters, whole, percent))


def _differing(spark, met: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets (leader, set_id, n, label) of one leader and two components that may link.

    With d and e the numbers of tokens in which they differ from the leader, and c of those in which both do, they
    differ from one another in d + e - 2 c tokens; at most (100 - percent) / (100 + percent) of both sizes if they link.
    """
    of_leader = whole.select(F.col("set_id").alias("leader"), F.col("shingles").alias("of_leader"))
    tokens = met.join(whole, "set_id").join(of_leader, "leader").withColumn("tokens", F.concat(
        F.array_except("shingles", "of_leader"), F.array_except("of_leader", "shingles")))
    sets = written(spark, tokens.select("leader", "set_id", "n", "label", F.size("tokens").alias("size"), "tokens"), "differing")
    each = sets.select("leader", "set_id", F.explode("tokens").alias("token"))
    docs = each.groupBy("leader", "token").agg(F.count(F.lit(1)).alias("docs")).filter("docs > 1")
    shared = each.join(docs, ["leader", "token"]).groupBy("leader", "set_id").agg(F.array_sort(F.collect_list(F.struct("docs", "token"))).alias("shared"))
    # rarest first: the tokens that no other set differs in stand before the shared ones
    placed = sets.drop("tokens").join(shared, ["leader", "set_id"]).select(
        "leader", "set_id", "n", "label", "size", (F.col("size") - F.size("shared")).alias("own"), F.posexplode("shared").alias("place", "t")).select(
        "leader", "set_id", "n", "label", "size", (F.col("size") - F.col("own") - F.col("place")).alias("rest"), F.col("t.token").alias("token"))
    # the first token that two such sets share stands within this prefix of both, and the rest holds enough more
    placed = written(spark, placed.filter(percent * (F.col("size") - F.col("rest")) <= (100 - percent) * F.col("n")), "prefixes")
    others = placed.select("leader", "token", *(F.col(c).alias(f"l_{c}") for c in ("set_id", "n", "label", "size", "rest")))
    differ = (100 + percent) * (F.col("size") + F.col("l_size") - 2 * F.least("rest", "l_rest"))
    return _dealt(placed, others, ["leader", "token"]).filter(
        (F.col("set_id") < F.col("l_set_id")) & (F.col("label") != F.col("l_label")) & _alike(F.col("n"), F.col("l_n"), percent)
        & (differ <= (100 - percent) * (F.col("n") + F.col("l_n")))).select(*_pairs())


def _only(one: str, other: str) -> Column:
    """How many bits only the first map has."""
    return F.aggregate(F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, n: s + n)


def _both_sides(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with what ``sets`` has of both; where the pairs are few, ``sets`` is not shuffled."""
    few = pairs.count() <= MOST_BROADCAST
    names = [c for c in sets.columns if c != "set_id"]
    sides = [
        sets.join(F.broadcast(pairs) if few else pairs, F.col("set_id") == F.col(side)).select(
            "a", "b", *(F.col(c).alias(f"{side}_{c}") for c in names)) for side in ("a", "b")]
    return sides[0].join(sides[1], ["a", "b"])


def _verified(pairs: DataFrame, filters: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a prefix token in the other orders too, whose maps leave enough in common, and whose sets have it."""
    spark = pairs.sparkSession
    filtered = _both_sides(pairs, filters)
    for k in range(len(ORDERS) - 1):
        filtered = filtered.filter(F.arrays_overlap(f"a_p{k}", f"b_p{k}"))
    most = F.least(F.col("a_n") - _only("a_bits", "b_bits"), F.col("b_n") - _only("b_bits", "a_bits"))
    filtered = filtered.filter(100 * most >= percent * (F.col("a_n") + F.col("b_n") - most))
    filtered = written(spark, filtered.select("a", "b"), "candidates")
    found = _both_sides(filtered, whole)
    both = F.size(F.array_intersect("a_shingles", "b_shingles"))
    found = found.select("a", "b", (F.size("a_shingles") + F.size("b_shingles")).alias("sizes"), both.alias("both"))
    return written(spark, found.filter(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select("a", "b"), "links")
