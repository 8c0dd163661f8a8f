"""Line dedup by a log-template tree.

A line is parsed by a tree of fixed depth: its number of tokens, then its ``lead`` first
tokens; tokens with a digit stand for any (``<*>``). That gives the leaf. In a leaf, a
place of a line is variable if no other line (with another wording) has the same token
there, or if another line has another token there and is the same at all other places: so
fields whose values repeat, and cross each other, are found too. Such tokens are generalised
to ``<*>`` (all of them, or else those of the first kind, or else the one place that most lines
differ in), and lines that have become alike are one template. A line is generalised only while at least ``alike`` of its places, and half of
all, stay fixed; else it keeps its wording and takes no further part. This is repeated
with the templates in place of lines until nothing changes, so a field may have frequent
and rare values. So lines of one template agree in ``alike`` of all places. The result
depends on no order of lines, and a leaf holds any number of templates.

A template recurs if it is found in ``least`` or more different texts; its lines are then
dropped, except from the first text that holds it (the one with the smallest id), so that
its content stays once. Copies of a text count as one text and are treated alike: whole
copies are another operator's matter.

Templates take no lines of fewer than ``shortest`` tokens, or with less than half of their
tokens fixed. Besides, a line of ``long`` characters or more (blanks counted once) that is
found alike, digits too, in two or more different texts is dropped in the same way,
whatever its tokens are. Blank lines, and short lines of one or two tokens, are never
dropped: in a large corpus those meet by chance in clean prose.

How it is dealt: small rows of hashes (128 bits for lines and texts) are counted first,
texts and lines together as the key, so that a line in a third of all texts spreads over
all tasks. Only lines of leaves that are met often enough travel as text; a bit map of
bounded size tells executors which (a wrong hit costs a row, nothing else). Generalising
counts (leaf, place, token) and (leaf, place, digest of all other places), summed before the
shuffle; a token met once names its line, and lines that are the same but for one place meet
by that digest, so that nothing is joined to a hot leaf.

Defined results. Null text: stays null, no lines. Empty text: one blank line. Repeated
rows: copies. Null ids: their texts can't be a first one before any id. Ties: the smaller
text hash is first. Empty table: no rows. Very long lines and texts: whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, discard, marks, materialise, sifted, stored, text_bytes

LEAD = 4
ALIKE = 0.7
#: Different texts that hold a template; an exact long line needs two.
LEAST = 3
SHORTEST = 3
#: Characters of a line that is dropped from the second text on.
LONG = 40
SHARD_BYTES = 4 << 20
ANY = b"<*>"
#: Bytes that begin a character.
FIRST = bytes(c for c in range(256) if c & 0xC0 != 0x80)

_digit = re.compile(rb"[0-9]")


def parsed(line: bytes) -> list[bytes]:
    """Tokens of a line; those with a digit stand for any."""
    tokens = line.split()
    return [ANY if _digit.search(t) else t for t in tokens] if _digit.search(line) else tokens


def line_key(tokens: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(tokens))


def leaf_key(tokens: list[bytes], lead: int) -> int:
    return xxhash.xxh64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:lead])) - (1 << 63)


def exact_key(line: bytes, long: int) -> bytes | None:
    """Of the line as it is but for its blanks; none for a short one."""
    if len(line) < long:
        return None
    words = b" ".join(line.split())
    if len(words) < long or len(words) - len(words.translate(None, FIRST)) < long:
        return None
    return xxhash.xxh3_128_digest(b"= " + words)


def worth(tokens: list[bytes], shortest: int) -> bool:
    return len(tokens) >= shortest and 2 * tokens.count(ANY) <= len(tokens)


def _keys(lead: int, shortest: int, long: int):
    """A row for each line of a text: by its template tokens, and by itself where that is another wording."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", SHARD_BYTES):
            row, leaf, key, alone = [], [], [], []
            for i, text in enumerate(text_bytes(batch.column("text"))):
                seen = set()
                for line in (text or b"").split(b"\n"):
                    tokens, own = parsed(line), exact_key(line, long)
                    found = []
                    if worth(tokens, shortest):
                        plain = ANY not in tokens
                        found.append((line_key(tokens), leaf_key(tokens, lead), plain and own is not None))
                        own = None if plain else own
                    if own is not None:
                        found.append((own, None, True))
                    for k, at, whole in found:
                        if k not in seen:
                            seen.add(k)
                            row.append(i)
                            leaf.append(at)
                            key.append(k)
                            alone.append(whole)
            at = pa.array(row, pa.int64())
            yield pa.record_batch([batch.column("text_key").take(at), batch.column("doc_id").take(at), pa.array(leaf, pa.int64()), pa.array(key, pa.binary()), pa.array(alone, pa.bool_())], names=["text_key", "doc_id", "leaf", "line", "exact"])

    return keys


def _texts(shared, lead: int, shortest: int):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: np.ndarray = shared.value
        mask = len(known) * 64 - 1
        for batch in chunked(batches, "text", SHARD_BYTES):
            found: dict[bytes, tuple[int, bytes]] = {}
            for text in text_bytes(batch.column("text")):
                for line in (text or b"").split(b"\n"):
                    tokens = parsed(line)
                    if worth(tokens, shortest):
                        leaf = leaf_key(tokens, lead)
                        if int(known[(leaf & mask) >> 6]) >> (leaf & 63) & 1:
                            found[line_key(tokens)] = leaf, b" ".join(tokens)
            leaf, words = zip(*found.values(), strict=True) if found else ((), ())
            yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(leaf, pa.int64()), pa.array(words, pa.binary()).cast(pa.string())], names=["line", "leaf", "words"])

    return texts


def _places(words, wanted):
    """How many tokens of a line are as wanted."""
    return F.size(F.filter(F.split(words, " "), wanted))


def generalised(lines: DataFrame, lead: int, alike: float) -> DataFrame:
    """(line, template): lines (line, leaf, words) of any number, by the wording of their templates; the template is a hash of 128 bits."""
    spark = lines.sparkSession
    any_token = F.lit(ANY.decode())
    play, path = stored(lines.select("line", "leaf", "words", _places(F.col("words"), lambda t: t == any_token).alias("own"), F.xxhash64("leaf", "words").alias("form")), "wordings")
    settled = []
    while True:
        hashes = F.transform(F.split("words", " "), lambda t, i: F.xxhash64(i, t))
        all_places = F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))
        # The digest is written: beside the explode it would be worked out for every token.
        forms, forms_path = stored(play.groupBy("form", "leaf", "words").agg(F.min("own").alias("own")).withColumn("all", all_places), "forms")
        tokens = forms.select("leaf", "form", "all", F.posexplode(F.split("words", " ")).alias("place", "token")).where((F.col("place") >= lead) & (F.col("token") != any_token))
        tokens = tokens.select("leaf", "form", "place", F.xxhash64("place", "token").alias("token"), F.col("all").bitwiseXOR(F.xxhash64("place", "token")).alias("others"))
        once = tokens.groupBy("leaf", "place", "token").agg(F.count("*").alias("n"), F.min("form").alias("form")).where("n = 1").select("leaf", "form", "place", F.lit(0).cast("bigint").alias("n"))
        crossed, crossed_path = stored(tokens.groupBy("leaf", "place", "others").agg(F.count("*").alias("n")).where("n > 1"), "crossed")
        met = tokens.join(crossed.hint("merge"), ["leaf", "place", "others"]).select("leaf", "form", "place", "n")
        variable = once.unionByName(met).groupBy("leaf", "form").agg(F.collect_set("place").alias("every"), F.collect_set(F.when(F.col("n") == 0, F.col("place"))).alias("once"), F.max(F.struct("n", (-F.col("place")).alias("at"))).alias("most"))
        size = F.size(F.split("words", " "))
        stars = _places(F.col("words"), lambda t: t == any_token)
        fit = lambda places: (F.size(places) > 0) & (stars + F.size(places) - F.col("own") <= (1 - alike) * size) & (2 * (stars + F.size(places)) <= size)
        best = F.array(-F.col("most.at"))
        lone = F.when(fit(F.col("every")), F.col("every")).when(fit(F.col("once")), F.col("once")).when((F.col("most.n") > 0) & fit(best), best)
        lone = forms.join(variable, ["leaf", "form"]).select("leaf", "form", "words", lone.alias("lone"))
        fits = F.col("lone").isNotNull()
        wording = F.array_join(F.transform(F.split("words", " "), lambda t, i: F.when(F.array_contains("lone", i), any_token).otherwise(t)), " ")
        moved, moved_path = stored(lone.select("leaf", "form", F.col("words").alias("was"), fits.alias("fits"), F.when(fits, wording).alias("wider")), "wider")
        if not moved.count():
            discard(spark, forms_path, moved_path, crossed_path)
            break
        # Only leaves in which something changed are looked at again.
        changed, changed_path = stored(moved.select("leaf").distinct().withColumnRenamed("leaf", "again"), "changed")
        after = play.join(moved.drop("leaf").hint("merge"), ["form"], "left").where("was is null or was = words")
        after = after.select("line", "leaf", F.coalesce("wider", "words").alias("words"), "own", F.coalesce(~F.col("fits"), F.lit(False)).alias("out")).withColumn("form", F.xxhash64("leaf", "words"))
        after = after.join(changed.hint("merge"), F.col("leaf") == F.col("again"), "left").withColumn("done", F.col("out") | F.col("again").isNull()).drop("out", "again")
        after, after_path = stored(after, "wordings")
        discard(spark, forms_path, moved_path, crossed_path, changed_path, *([path] if not settled else []))  # later ones hold what has settled
        settled.append(after.where("done").drop("done"))
        play, path = after.where("not done").drop("done"), after_path
    for part in settled:
        play = play.unionByName(part)
    return play.select("line", F.unhex(F.md5(F.concat(F.col("leaf").cast("string"), F.lit(" "), F.col("words")).cast("binary"))).alias("template"))


def _cleaner(text_col: str, shortest: int, long: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, text_col, SHARD_BYTES):
            texts, lines, dropped = [], [], []
            for text, gone in zip(text_bytes(batch.column(text_col)), batch.column("__lx_gone"), strict=True):
                parts = text.split(b"\n") if text is not None else []
                kept = parts
                if gone.is_valid and len(gone):
                    keys = set(gone.as_py())
                    kept = [p for p in parts if not (worth(t := parsed(p), shortest) and line_key(t) in keys or exact_key(p, long) in keys)]
                texts.append(None if text is None else text if len(kept) == len(parts) else b"\n".join(kept))
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            at = batch.schema.get_field_index(text_col)
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)).drop_columns(["__lx_gone"])
            yield out.append_column("__lx_lines", pa.array(lines, pa.int64())).append_column("__lx_dropped", pa.array(dropped, pa.int64()))

    return clean


def recurring(docs: DataFrame, lead: int = LEAD, alike: float = ALIKE, least: int = LEAST, shortest: int = SHORTEST, long: int = LONG) -> DataFrame:
    """(text_key, lines): for each text (doc_id, text, text_key), the keys of its lines to drop."""
    spark = docs.sparkSession
    seen = docs.mapInArrow(_keys(lead, shortest, long), "text_key binary, doc_id bigint, leaf bigint, line binary, exact boolean")
    seen = materialise(seen.groupBy("line", "leaf", "exact", "text_key").agg(F.min("doc_id").alias("doc_id")), "lines")
    leaves = seen.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high"))
    leaves = materialise(leaves.where((F.col("n") >= least) & (F.col("low") != F.col("high"))).select("leaf"), "leaves")  # one line alone needs no template
    known = marks(leaves, "leaf")
    lines = docs.select("text").mapInArrow(_texts(spark.sparkContext.broadcast(known), lead, shortest), "line binary, leaf bigint, words string")
    lines = lines.groupBy("line").agg(F.min(F.struct("leaf", "words")).alias("x")).select("line", "x.leaf", "x.words")
    templates = generalised(lines, lead, alike).withColumn("least", F.lit(least))
    exact = seen.where("exact").groupBy("line").agg(F.count("*").alias("n")).where("n >= 2").select("line", F.col("line").alias("template"), F.lit(2).alias("least"))
    again = seen.where("leaf is not null").groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("line", F.col("line").alias("template"), F.lit(least).alias("least"))
    templates = materialise(templates.unionByName(exact).unionByName(again), "templates")

    maybe, _ = sifted(seen.withColumn("__lx_hash", F.xxhash64("line")), templates.select(F.xxhash64("line").alias("__lx_hash")), "__lx_hash", "__lx_hash")
    held = materialise(maybe.join(templates.hint("merge"), "line").select("template", "least", "line", "text_key", "doc_id"), "held")
    texts = held.groupBy("template", "least", "text_key").agg(F.min("doc_id").alias("doc_id"))
    ids = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    often = texts.groupBy("template", "least").agg(F.count("*").alias("n"), F.min(F.struct(ids.alias("doc_id"), F.col("text_key").alias("first"))).alias("x")).where(F.col("n") >= F.col("least"))
    often = materialise(often.select("template", "x.first"), "often")  # two plain shuffles meet, so a hot template can be split
    gone = held.join(often.hint("merge"), "template").where(F.col("text_key") != F.col("first"))
    return gone.groupBy("text_key").agg(F.collect_set("line").alias("lines"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, long: int = LONG, **options) -> DataFrame:
    """All rows and columns of docs, the text without its recurring lines, and __lx_lines and __lx_dropped: how many it had and lost."""
    key = F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))
    view = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("text_key"))
    gone = materialise(recurring(view, shortest=shortest, long=long, **options), "recurring").select(F.col("text_key").alias("__lx_key"), F.col("lines").alias("__lx_gone"))
    hashed = docs.withColumn("__lx_text", key).withColumn("__lx_hash", F.xxhash64("__lx_text"))
    maybe, rest = sifted(hashed, gone.select(F.xxhash64("__lx_key").alias("__lx_hash")), "__lx_hash", "__lx_hash")
    joined = maybe.join(gone.hint("merge"), F.col("__lx_text") == F.col("__lx_key"), "left").drop("__lx_key", "__lx_hash", "__lx_text")
    joined = joined.unionByName(rest.drop("__lx_hash", "__lx_text").withColumn("__lx_gone", F.lit(None).cast("array<binary>")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(_cleaner(text_col, shortest, long), f"{fields}, `__lx_lines` bigint, `__lx_dropped` bigint")
