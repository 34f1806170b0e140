"""Order MinHash fingerprints, in DataFrame functions alone.

A text is the sequence of its k-mers (three words each), and repeats of a k-mer are
numbered, so that every numbered k-mer is there once. A hash of each deals them into
slots and ranks them; every slot keeps its smallest two, puts them back into text
order and hashes the tuple. Texts agree in a slot if they share these k-mers in the same
order, which falls with their edit distance, not only with the words they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.arrays import let
from veilspark.llm.common import stored, table

KMER = 3
TUPLE = 2
SLOT_BITS = 6
#: Bits of a position in a packed number: 67 million words.
_AT_BITS = 26
_AT = (1 << _AT_BITS) - 1
_RANK = (1 << (64 - _AT_BITS)) - 1
#: Values of a slot are 1 to 65,535; 0 is an empty slot.
_VALUES = 65_535


def _at(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_AT))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, _AT_BITS)


def _packed(value: Column, at: Column) -> Column:
    """The upper bits of a hash, and a position; packed numbers sort by the hash first."""
    return value.bitwiseAND(F.lit(~_AT)).bitwiseOR(at)


def _units(text: Column, unit: str) -> Column:
    parts = F.split(text, r"[\x20\x09-\x0D]+" if unit == "word" else "", F.lit(-1))
    return F.array_remove(parts, "")


def signature(text: Column, *, kmer: int = KMER, size: int = TUPLE, slot_bits: int = SLOT_BITS, unit: str = "word") -> Column:
    """The slots of a text as an array of ``2 ** slot_bits`` numbers, 0 where no k-mer fell.

    ``unit`` is ``word`` or ``char``. A text of fewer units than ``kmer`` is one k-mer, a text
    without any has empty slots, null reads as empty. Work is about linear in the text,
    but for two sorts of 64-bit numbers.
    """

    def kmers(hashes: Column) -> Column:
        spans = F.sequence(F.lit(0), F.greatest(F.size(hashes) - kmer, F.lit(0)))

        def one(at: Column) -> Column:
            value = F.xxhash64(*[F.get(hashes, at + j) for j in range(kmer)])
            return _packed(value, at.cast("long"))

        # No sequence for a text without units.
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.transform(spans, one)))

    def starts(packed: Column, key) -> Column:
        """Where a new key begins in a sorted array."""
        every = F.filter(
            F.sequence(F.lit(0), F.size(packed) - 1),
            lambda i: (i == 0) | (key(F.get(packed, i)) != key(F.get(packed, i - 1))),
        )
        return F.when(F.size(packed) == 0, F.array().cast("array<int>")).otherwise(every)

    def numbered(packed: Column, begins: Column) -> Column:
        def run(begin: Column, j: Column) -> Column:
            end = F.coalesce(F.get(begins, j + 1), F.size(packed))
            return F.transform(F.slice(packed, begin + 1, end - begin), ranked)

        def ranked(x: Column, occurrence: Column) -> Column:
            return _packed(F.xxhash64(_hash(x), occurrence), _at(x))

        return F.array_sort(F.flatten(F.transform(begins, run)))

    def slot(packed: Column) -> Column:
        return F.shiftrightunsigned(packed, 64 - slot_bits)

    def tuples(packed: Column, begins: Column) -> Column:
        def one(begin: Column) -> Column:
            own = F.filter(F.slice(packed, begin + 1, F.lit(size)), lambda x: slot(x) == slot(F.get(packed, begin)))
            in_order = F.array_sort(
                F.transform(own, lambda x: F.shiftleft(_at(x), 64 - _AT_BITS).bitwiseOR(_hash(x).bitwiseAND(F.lit(_RANK))))
            )
            ranks = F.transform(in_order, lambda x: x.bitwiseAND(F.lit(_RANK)))
            value = F.pmod(F.xxhash64(ranks), F.lit(_VALUES)) + 1
            return F.struct(slot(F.get(packed, begin)).cast("int").alias("slot"), value.cast("int").alias("value"))

        return F.transform(begins, one)

    def spread(filled: Column) -> Column:
        by_slot = F.map_from_entries(filled)
        return let(by_slot, lambda m: F.transform(F.sequence(F.lit(0), F.lit((1 << slot_bits) - 1)), lambda s: F.coalesce(F.try_element_at(m, s), F.lit(0))))

    words = F.transform(_units(F.coalesce(text, F.lit("")), unit), lambda w: F.xxhash64(w))
    ranked_kmers = let(let(words, kmers), lambda p: let(starts(p, _hash), lambda b: numbered(p, b)))
    return let(ranked_kmers, lambda p: let(let(starts(p, slot), lambda b: tuples(p, b)), spread))


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots filled in either signature that agree; 1 for two empty ones."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(((x == y) & (x != 0)).alias("same"), ((x != 0) | (y != 0)).alias("some")))

    def share(p: Column) -> Column:
        some = F.size(F.filter(p, lambda q: q["some"]))
        return F.when(some == 0, F.lit(1.0)).otherwise(F.size(F.filter(p, lambda q: q["same"])) / some)

    return let(pairs, share)


def written(slots: Column) -> Column:
    """A signature as text: four hexadecimal digits for each slot."""
    return F.array_join(F.transform(slots, lambda v: F.lpad(F.lower(F.hex(v)), 4, "0")), "")


def fingerprints(docs: DataFrame, **parameters) -> DataFrame:
    """``doc_id, signature`` for each row of ``docs`` (``doc_id, text``); equal texts have equal signatures.

    Null texts read as empty; repeated rows and null ids stay; other columns are not carried.
    """
    return docs.select("doc_id", signature(docs["text"], **parameters).alias("signature"))


#: Ranges of ids that rows are dealt into, and the text that a part of a range is meant to have.
RANGES = 512
PART_BYTES = 32 << 20


def with_next(docs: DataFrame, ranges: int = RANGES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) and the next one in descending id; after the last comes the first.

    Returns ``doc_id, text, signature, next_text, next_signature``. Ids run down with null
    last, rows of one id by a hash of the text. Rows are dealt once, into ranges of ids by
    quantile and equal parts of a range; each part is given the first row of the part after
    it, so no window goes across parts.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    slim = slim.withColumn("mark", F.shiftrightunsigned(F.xxhash64("text"), 1))
    shares = [i / ranges for i in range(ranges + 1)]
    facts = slim.agg(
        F.percentile_approx("doc_id", shares, 100_000).alias("bounds"), F.sum(F.octet_length("text")).alias("bytes")
    ).first()
    bounds = sorted(set(facts["bounds"] or [0]))
    parts = max(1, -(-(facts["bytes"] or 0) // (ranges * part_bytes)))
    bound = F.array(*[F.lit(b).cast("long") for b in bounds])
    top = len(bounds) + 1
    # Range of an id: how many bounds it reaches; then its part of the way to the next bound.
    reached = F.size(F.filter(bound, lambda b: b <= F.col("doc_id")))
    low, high = F.get(bound, F.col("reached") - 1), F.get(bound, F.col("reached"))
    along = F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * parts)
    inside = F.least(F.greatest(F.coalesce(along, F.lit(0)), F.lit(0)), F.lit(parts - 1))
    named = (top - F.col("reached")) * parts + (parts - 1 - inside)
    nameless = top * parts + parts + F.floor(F.col("mark") / F.lit(float(1 << 63)) * ranges * parts)
    part = F.when(F.col("doc_id").isNull(), nameless).otherwise(named).cast("long")
    dealt = slim.withColumn("reached", reached).withColumn("part", part).drop("reached")

    first = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", (-F.col("mark")).alias("mark"))
    firsts = dealt.select("part", "doc_id", "mark").groupBy("part").agg(F.max(first).alias("first"))
    order = Window.orderBy("part")  # a row for each part
    linked = firsts.select(
        F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("into"),
        F.col("first.doc_id").alias("f_doc_id"),
        (-F.col("first.mark")).alias("f_mark"),
    )
    linked = stored(linked, "part-firsts")
    fetched = slim.join(F.broadcast(linked), F.expr("doc_id <=> f_doc_id AND mark = f_mark")) if parts == 1 else slim.join(
        linked, F.expr("doc_id <=> f_doc_id AND mark = f_mark")
    )
    fetched = stored(fetched.select("into", "text").dropDuplicates(["into"]), "first-texts")

    rows = dealt.select("part", F.lit(False).alias("edge"), "doc_id", "mark", "text")
    edges = fetched.select(
        F.col("into").alias("part"), F.lit(True).alias("edge"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("mark"), "text"
    )
    signed = rows.unionByName(edges).withColumn("signature", signature(F.col("text")))
    down = Window.partitionBy("part").orderBy("edge", F.col("doc_id").desc_nulls_last(), "mark")
    followed = signed.withColumns({"next_text": F.lead("text").over(down), "next_signature": F.lead("signature").over(down)})
    return followed.where(~F.col("edge")).drop("part", "edge", "mark")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of the text with its second half from the next document."""
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    docs = docs.withColumns({"n": n.cast("long"), "edited": edited}).drop("text", "next_text")
    docs = docs.withColumn("edited_signature", signature(F.col("edited")))
    return docs.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("signature")).alias("fingerprint"),
        written(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
