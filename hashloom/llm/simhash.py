"""SimHash near-duplicate detection by multi-index hashing.

A document becomes a 64-bit fingerprint: each bit is set when it is set in more than half of the
64-bit hashes of the document's word shingles, repeats included.  Two fingerprints are linked
when at most three bits differ.  If the 64 bits are cut into two 32-bit segments, one segment of
any linked pair differs in at most one bit; so each fingerprint is stored in a table under both
segments and looks up the Hamming ball of radius one around each segment.  A pair that differs in
one segment bit is found from its member with that bit clear, which halves the balls (17 keys a
segment on average).  Every match is verified on the full 64 bits.

Equal fingerprints collapse before anything is joined, so exact copies never form pairs.  A table
key with more than ``hot`` fingerprints (many near copies of one text) is not paired up: its
members are joined to virtual points of the other segment, so that the work grows linearly with
the group and no reachable document is lost (see ``_hot_edges``).

Dropping near duplicates (``keep_one``) asks for a similarity of word shingles, five words and 0.8 by default, which a distance of three bits
is far too strict for.  There the same index holds wider fingerprints (192 bits of a text's distinct words, six segments), which
finds whatever differs in at most eleven bits and most of what differs in a few more; pairs within ``WITHIN`` bits are candidates,
and the Jaccard similarity of their whole texts' shingles decides.  A pair that cannot reach the similarity is left out where the two meet, before
it is a row: each text carries its number of shingles and, for 512 classes of their hashes, whether it has an odd number in each.  Two shingle sets
differ in at least as many shingles as these parities differ, so no pair that reaches the similarity is lost; texts of
far more than 500 shingles fill all classes, and theirs are all looked at.  Crowded keys are worked off in rounds: some members of a key are
compared with all others of it, what is similar goes, and so on until few enough are left to be paired (see ``similar``).

Inputs are never changed.  Null text counts as empty; a text without words has fingerprint zero
and is linked like any other; rows repeated in the input are repeated in the output; a null
``doc_id`` takes part but never names a component; extra columns are ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hashloom.llm._arrow import rows, utf8
from hashloom.plans.graph import connected_components
from hashloom.plans.hot import fresh, hinted, join_salted
from hashloom.scratch import materialize

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
SPAN = 1 << 16
LANES = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd factors that make 64-bit lanes of one hash
ACROSS = 16  # bits by which a candidate pair may differ in another lane
WITHIN = 26  # bits by which a candidate pair may differ in all lanes
PARITIES = 8  # words of 64 parities of shingle classes that a text carries
FEATURES = [*(f"f{k}" for k in range(len(LANES))), "n", *(f"p{k}" for k in range(PARITIES))]  # what a text carries to each meeting
POPULAR = 8  # nodes of a key from which on those one bit away are compared with its head first
LEADERS = 16  # members of a crowded key that the first round compares with all others; each round takes four times as many


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text; words end at ASCII white space only."""
    from xxhash import xxh64_intdigest as h

    words = utf8(text).translate(LOWER).split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    counts, total = np.zeros((8, 8), np.int64), 0
    for at in range(0, last, SPAN):
        got = np.fromiter((h(b" ".join(words[k : k + shingle]), seed) for k in range(at, min(last, at + SPAN))), np.uint64)
        lanes = got.view(np.uint8).reshape(-1, 8)
        counts += np.stack([np.bincount(lanes[:, k], minlength=256) @ BITS for k in range(8)])
        total += len(got)
    return int.from_bytes(np.packbits(2 * counts > total, axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, h, fp)``: the text's hash, and the fingerprint's bit pattern as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "h", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text).mapInArrow(run, "doc_id long, h long, fp long")


def _half(fp: Column, seg: int) -> Column:
    return fp.bitwiseAND(0xFFFFFFFF) if seg == 0 else F.shiftrightunsigned(fp, 32)


def _keys(fps: DataFrame, flips: bool) -> DataFrame:
    """``(seg, key, flip, fp)``: the fingerprint's own segments, and with ``flips`` those with one clear bit set."""
    fp = F.col("fp")
    parts = []
    for seg in (0, 1):
        half = _half(fp, seg)
        own = F.array(F.struct(F.lit(seg).alias("seg"), half.alias("key"), F.lit(False).alias("flip")))
        if flips:
            ups = [F.when(half.bitwiseAND(1 << k) == 0, F.struct(F.lit(seg).alias("seg"), half.bitwiseOR(1 << k).alias("key"), F.lit(True).alias("flip"))) for k in range(32)]
            own = F.concat(own, F.array_compact(F.array(*ups)))
        parts.append(own)
    return fps.select("fp", F.explode(F.concat(*parts)).alias("k")).select("k.seg", "k.key", "k.flip", "fp")


def _hot_edges(table: DataFrame, probes: DataFrame) -> DataFrame:
    """Edges that connect exactly what the pairs of crowded keys connect, with no pair listed.

    Below one key the first segments agree, so links are decided by the other segment.  Around it
    each stored member marks the points at distance at most one (near) and two (far); a prober, which
    has spent one bit already, marks those at distance at most one.  All marks on a point that has a
    near one are within three bits of that near member, and any linked pair shares such a point.
    """
    one = [1 << k for k in range(32)]
    two = [a | b for i, a in enumerate(one) for b in one[i + 1 :]]

    def marks(df: DataFrame, masks: list[int], near: bool) -> DataFrame:
        other = F.when(F.col("seg") == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
        return df.select("seg", "key", "fp", F.lit(near).alias("near"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"), other.alias("other")).select(
            "seg", "key", "fp", "near", F.col("other").bitwiseXOR(F.col("mask")).alias("point")
        )

    flipped = probes.filter("flip")
    at = ["seg", "key", "point"]
    all_marks = marks(table, [0, *one], True).unionByName(marks(table, two, False)).unionByName(marks(flipped, [0, *one], False))
    centre = all_marks.groupBy(*at).agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("src"), F.count(F.lit(1)).alias("n")).filter("src is not null and n > 1")
    return all_marks.join(centre, at).filter("src <> fp").select("src", F.col("fp").alias("dst")).distinct()


def links(fps: DataFrame, max_bits: int = 3, hot: int = 64) -> DataFrame:
    """Edges ``(src, dst)`` over distinct fingerprints that give the components of all links of at most ``max_bits``."""
    if max_bits != 3:
        raise ValueError("two segments with balls of radius one serve a distance of three")
    table, probes = _keys(fps, False), _keys(fps, True)
    at = ["seg", "key"]
    crowded, _ = materialize(table.groupBy(*at).count().filter(F.col("count") > hot).select(*at), "crowded")
    calm = table.join(crowded, at, "left_anti").select(*at, F.col("fp").alias("src"))
    other = probes.select(*at, "flip", F.col("fp").alias("dst"))
    pairs = calm.join(other, at).filter((F.col("flip") | (F.col("src") < F.col("dst"))) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits)).select("src", "dst")
    if crowded.isEmpty():
        return pairs
    return pairs.unionByName(_hot_edges(table.join(crowded, at, "left_semi"), probes.join(crowded, at, "left_semi")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, max_bits: int = 3, hot: int = 64) -> DataFrame:
    """``(doc_id, h, fp, root, component_id)`` for each row of ``docs``.

    ``root`` is the component's smallest fingerprint, ``component_id`` the smallest reachable ``doc_id`` (null if all are null).
    """
    marked, _ = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct, _ = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct")
    comps = connected_components(links(distinct.select("fp"), max_bits, hot))
    inside, _ = materialize(distinct.join(comps.withColumnRenamed("node", "fp"), "fp"), "inside")
    lowest = inside.groupBy("component").agg(F.min("rep").alias("low"))
    grouped = join_salted(inside, lowest, "component", "fp").select("fp", "low", "component")
    named = distinct.join(grouped, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("low")).alias("component_id"))
    return join_salted(marked, named, "fp", "doc_id", distinct.select("fp", "n")).select("doc_id", "h", "fp", "root", "component_id")


def lanes(words: list[bytes]) -> list[int]:
    """SimHash of a set of words in 64-bit lanes, as signed numbers."""
    from xxhash import xxh64_intdigest as h

    if not words:
        return [0] * len(LANES)
    x = np.fromiter(map(h, set(words)), np.uint64)
    total = np.zeros(64 * len(LANES), np.int64)
    for at in range(0, len(x), SPAN):
        part = x[at : at + SPAN, None] * np.array(LANES, np.uint64)
        part[:, 1:] ^= part[:, 1:] >> np.uint64(29)
        part[:, 1:] *= np.uint64(0x165667B19E3779F9)
        part[:, 1:] ^= part[:, 1:] >> np.uint64(32)
        total += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(x), bitorder="little").view(np.int64).tolist()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words (a shorter text is one run), as signed numbers."""
    from xxhash import xxh64_intdigest as h

    return np.unique(np.fromiter((h(b" ".join(words[k : k + size])) for k in range(max(1, len(words) - size + 1) if words else 0)), np.uint64)).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """For 512 classes of a set of hashes, a bit each: whether it has an odd number of them; as signed words."""
    odd = np.bincount(hashes & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(doc_id, h, node, f0, f1, f2, n, p0 ...)``: the text's hash, that of its words in order, the lanes, the number of its shingles and their parities."""
    from xxhash import xxh64_intdigest

    names = ["doc_id", "h", "node", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            words = [utf8(t).translate(LOWER).split() for t in b.column(2).to_pylist()]
            node = np.fromiter((xxh64_intdigest(b" ".join(w)) for w in words), np.uint64).view(np.int64)
            f = np.array([[*lanes(w), len(s := shingles(w, shingle)), *parities(s)] for w in words], np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), *(pa.array(np.ascontiguousarray(c)) for c in f.T)], names)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _segments(nodes: DataFrame) -> DataFrame:
    """``(key, node, other)`` for each 32-bit segment: its number and value as one key, and the next lane."""
    n = len(LANES)
    cells = [F.struct(F.shiftleft(F.lit(2 * k + seg).cast("long"), 32).bitwiseOR(_half(F.col(f"f{k}"), seg)).alias("key"), F.col(f"f{(k + 1) % n}").alias("other")) for k in range(n) for seg in (0, 1)]
    return nodes.select("node", F.explode(F.array(*cells)).alias("s")).select("s.key", "node", "s.other")


def _probes(segments: DataFrame) -> DataFrame:
    """Segments with one clear bit set."""
    rest = [c for c in segments.columns if c != "key"]
    masks = F.explode(F.array(*[F.lit(1 << k).cast("long") for k in range(32)])).alias("mask")
    return segments.select("key", *rest, masks).filter(F.col("key").bitwiseAND(F.col("mask")) == 0).select(F.col("key").bitwiseOR(F.col("mask")).alias("key"), *rest)


def _differing(names: list[str]) -> Column:
    """In how many bits columns ``a...`` and ``b...`` differ."""
    return sum((F.bit_count(F.col(f"a{f}").bitwiseXOR(F.col(f"b{f}"))) for f in names[1:]), F.bit_count(F.col(f"a{names[0]}").bitwiseXOR(F.col(f"b{names[0]}"))))


def _possible(similarity: float) -> Column:
    """Whether features ``a...`` and ``b...`` are within ``WITHIN`` bits and allow the similarity: sets of ``similarity`` t differ in at most (1 - t) / (1 + t) of their sizes' sum."""
    differ = F.greatest(_differing([f for f in FEATURES if f[0] == "p"]).cast("long"), F.abs(F.col("an") - F.col("bn")))
    return (_differing([f for f in FEATURES if f[0] == "f"]) <= WITHIN) & (differ * (1 + similarity) <= (F.col("an") + F.col("bn")) * (1 - similarity) + 1e-6)


def _sided(df: DataFrame, side: str, *rest: str) -> DataFrame:
    """``key``, the node as ``side`` and its features and component with that letter before their names."""
    return df.select("key", *rest, F.col("node").alias(side), *[F.col(f).alias(f"{side}{f}") for f in [*FEATURES, "c"] if f in df.columns])


def _across() -> Column:
    """Whether the lane after the one that the key is of is close too."""
    n, lane = len(LANES), F.shiftright("key", 33)
    bits = [F.bit_count(F.col(f"af{k}").bitwiseXOR(F.col(f"bf{k}"))) for k in range(n)]
    return F.when(lane == 0, bits[1]).when(lane == 1, bits[2]).otherwise(bits[0]) <= ACROSS


def _met(a: DataFrame, b: DataFrame, ordered: bool, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` below one key that are close, may be similar and are not known to be joined (``c``); with ``ordered`` each pair from its smaller member."""
    order = F.col("a") < F.col("b") if ordered else F.col("a") != F.col("b")
    met = _sided(a, "a").join(_sided(b, "b"), "key").filter(order & (F.col("ac") != F.col("bc")) & _across() & _possible(similarity))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _stars(members: DataFrame, probes: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs of each key's members with its head, and of what meets a key of more than ``POPULAR`` nodes with its head; a crowded key's rows are dealt to several tasks."""
    row = ["key", F.col("node").alias("a"), F.col("other").alias("ao")]
    head = heads.select("key", "b", "bo")
    popular = heads.filter(F.col("n") > POPULAR).select("key", "b", "bo")
    met = join_salted(members.select(*row), head, "key", "a", heads.select("key", "n")).unionByName(probes.select(*row).join(hinted(popular, 1 << 17), "key"))
    return met.filter((F.bit_count(F.col("ao").bitwiseXOR(F.col("bo"))) <= ACROSS) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _led(led: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """Pairs of the members of crowded keys with their keys' leaders that are close and may be similar, the members of a key dealt to several tasks."""
    salt = F.pmod(F.xxhash64("node"), F.lit(64)).alias("salt")
    right = _sided(leaders.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))), "b", "salt")
    met = _sided(led.withColumn("salt", salt), "a", "salt").join(right, ["key", "salt"])
    return met.filter((F.col("a") != F.col("b")) & _across() & _possible(similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs whose lanes are close and whose shingles are similar, as edges ``(src, dst)``."""
    once, _ = materialize(pairs.distinct(), "candidates")
    a = join_salted(once, nodes.select(F.col("node").alias("a"), *[F.col(f).alias(f"a{f}") for f in FEATURES]), "a", "b")
    near = join_salted(materialize(a, "sides")[0], nodes.select(F.col("node").alias("b"), *[F.col(f).alias(f"b{f}") for f in FEATURES]), "b", "a")
    close, _ = materialize(near.filter(_possible(similarity)).select("a", "b"), "close")
    if close.isEmpty():
        return close.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    held, _ = materialize(texts(close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()), "shingles")
    first, _ = materialize(join_salted(close, held.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a", "b"), "first")
    both = join_salted(first, held.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b", "a")
    na, nb = F.size("sa"), F.size("sb")
    possible = F.least(na, nb) >= similarity * F.greatest(na, nb)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(possible & ((na + nb == 0) | (common >= similarity * (na + nb - common)))).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def similar(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: float = 0.8, hot: int = 64) -> DataFrame:
    """The nodes of ``nodes(node, f0, f1, f2, n, p0 ..., r)`` that go: those that chains of similar pairs join to one of smaller ``r``.

    ``texts`` gives ``(node, s)``, the shingles of the nodes it is given.  First every key's most central node (that
    whose segments are shared most, which the text that others were made from is) is compared with the others of the key; nodes that chains of such pairs join meet no more, so a group of many near copies costs about a pair a copy and key.  Then
    keys of at most ``hot`` nodes are paired up.  For a crowded key, each round takes ``LEADERS`` of its nodes, compares them with all that meet there, and takes out the leaders and all that
    proved similar; a key of few enough nodes is paired up then.  So no two nodes that stay are left uncompared below any key.
    """
    segments, _ = materialize(_segments(nodes), "segments")
    counts, _ = materialize(segments.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 2"), "counts")
    members, _ = materialize(join_salted(segments.select("key", "node", "other"), counts, "key", "node", counts), "members")
    central = members.groupBy("node").agg(F.sum("n").alias("w"))
    top = members.join(central, "node").groupBy("key").agg(F.max(F.struct("w", "node", "other")).alias("l"), F.first("n").alias("n"))
    heads, _ = materialize(top.select("key", F.col("l.node").alias("b"), F.col("l.other").alias("bo"), "n"), "heads")
    crowded = heads.filter(F.col("n") > hot).select("key")
    some = not crowded.isEmpty()
    keys = hinted(crowded)
    joined, _ = materialize(connected_components(_verified(_stars(members, _probes(segments), heads), nodes, texts, similarity)), "joined")
    known, _ = materialize(nodes.join(hinted(joined), "node", "left").select("node", *FEATURES, F.coalesce("component", "node").alias("c")), "known")
    narrow = segments.select("key", "node")
    calm = narrow.join(keys, "key", "left_anti") if some else narrow
    # only what meets something gets its features: probes of keys that exist, then members that are probed or not alone
    guests, _ = materialize(_probes(narrow).join(calm.select("key"), "key", "left_semi").join(known, "node"), "guests")
    busy = guests.select("key").unionByName(calm.groupBy("key").count().filter("count > 1").select("key")).distinct()
    own, _ = materialize(calm.join(busy, "key", "left_semi").join(known, "node"), "own")
    edges = _verified(_met(own, own, True, similarity).unionByName(_met(own, guests, False, similarity)), nodes, texts, similarity)
    gone = _dropped(edges.unionByName(joined.select(F.col("node").alias("src"), F.col("component").alias("dst"))), nodes)
    if not some:
        return gone
    gone, _ = materialize(gone, "gone")
    out = [gone]
    staying = known.join(gone, "node", "left_anti")
    table, _ = materialize(narrow.join(keys, "key", "left_semi").join(staying, "node"), "table")
    visitors, _ = materialize(_probes(narrow).join(keys, "key", "left_semi").join(staying, "node"), "visitors")
    share = LEADERS
    while not table.isEmpty():
        crowded, _ = materialize(table.groupBy("key").count().filter(F.col("count") > hot).select("key"), "crowded")
        keys = hinted(crowded)
        full, calm = table.join(keys, "key", "left_semi"), table.join(keys, "key", "left_anti")
        # the smallest node of each share of a key, found without gathering the key
        leaders, _ = materialize(full.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(share))).agg(F.min(F.struct("node", *FEATURES)).alias("l")).select("key", "l.*"), "leaders")
        guests = visitors.join(keys, "key", "left_semi")
        pairs = _met(calm, calm, True, similarity).unionByName(_met(calm, visitors, False, similarity)).unionByName(_led(full.drop("c").unionByName(guests.drop("c")), leaders, similarity))
        gone, _ = materialize(_dropped(_verified(pairs, nodes, texts, similarity), nodes), "gone")
        out.append(gone)
        table, _ = materialize(full.join(gone, "node", "left_anti").join(leaders, ["key", "node"], "left_anti"), "table")
        visitors, _ = materialize(guests.join(gone, "node", "left_anti"), "visitors")
        share *= 4
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.distinct()


def _dropped(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of each component of ``edges`` but that of the smallest ``r``."""
    named, _ = materialize(connected_components(edges).join(nodes.select("node", "r"), "node"), "named")
    best = named.groupBy("component").agg(F.min(F.struct("r", "node")).alias("best")).select("component", F.col("best.node").alias("stays"))
    return join_salted(named.select("node", "component"), best, "component", "node").filter("node <> stays").select("node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, hot: int = 64) -> DataFrame:
    """One row of each group of near duplicates, with all its columns as they are.

    Texts of the same words count as one; the row of its smallest id (then smallest text hash) stands for it, rows without an id last.
    Of texts whose ``shingle``-word sets have a Jaccard similarity of ``similarity`` or more, in chains, that of the smallest row
    stays; in a crowd (see ``similar``) a text goes if it is similar to one that was kept.  Of rows that share id and text one stays,
    the first by the hash of all columns.
    """
    marked, _ = materialize(described(docs, id_col, text_col, shingle), "described")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    texts_of = marked.groupBy("node", *FEATURES).agg(F.min(rank).alias("r"))
    nodes, _ = materialize(texts_of, "nodes")
    text = F.col(text_col).cast("string")

    def texts(wanted: DataFrame) -> DataFrame:
        found = hinted(materialize(nodes.join(wanted, "node").select("node", F.col("r.doc_id").alias("rep"), F.col("r.h").alias("rep_h")), "wanted")[0])
        source = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("h"), text.alias("t"))
        met = source.join(found, F.col("i").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h"))).select("node", "t")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows(batches, 100):
                s = [shingles(utf8(t).translate(LOWER).split(), shingle) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.list_(pa.int64()))], ["node", "s"])

        return met.mapInArrow(run, "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s"))  # rows that repeat

    gone, _ = materialize(similar(nodes, texts, similarity, hot), "gone")
    kept, _ = materialize(nodes.join(gone, "node", "left_anti").select("r.doc_id", "r.h"), "kept")
    here = marked.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times"))
    k = kept.select(F.col("doc_id").alias("kid"), F.col("h").alias("kh"))
    state, _ = materialize(here.join(k, F.col("doc_id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh")), "left").select("doc_id", "h", "times", F.col("kh").isNotNull().alias("stays")), "state")
    i, h, row = fresh(docs.columns, "row_id", "row_hash", "row_number")
    same = lambda: F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h))
    named = lambda df: hinted(df.select(F.col("doc_id").alias(i), F.col("h").alias(h)))
    out = docs.join(named(state.filter(~F.col("stays"))), same(), "left_anti")
    again = state.filter(F.col("stays") & (F.col("times") > 1))
    if again.isEmpty():
        return out
    w = Window.partitionBy(F.col(id_col).cast("long"), F.xxhash64(text)).orderBy(F.xxhash64(*docs.columns))
    one = out.join(named(again), same(), "left_semi").withColumn(row, F.row_number().over(w)).filter(F.col(row) == 1).drop(row)
    return out.join(named(again), same(), "left_anti").unionByName(one)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
