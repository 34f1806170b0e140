"""Benchmark decontamination by template canonicalisation.

Words of benchmark items and documents become templates: numbers, names and units turn
into typed placeholders, numbers or names in a row into one. A capitalised word that
starts a sentence is read both as a plain word and as a name. Five-token windows of the templates are joined by hash. The
windows that a document shares with an item are lined up; the document is contaminated
where they cover enough of the item and its slots are filled consistently, so a
question with other numbers or names is found as well.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import product
from string import punctuation
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import stored, table
from veilspark.llm.words import SMALL_CHUNK_CHARS, Texts, chunks, coded_words

WINDOW = 5
#: Share of an item's windows that a document must hold ...
COVERAGE = 0.8
#: ... or tokens in a row that it shares with the item.
RUN = 13
#: A template window needs so many plain words; one with fewer is compared literally.
PLAIN = 2
#: The filter of benchmark windows that workers hold: 2^26 bits, 8 MB, whatever the benchmark's size.
FILTER_BITS = 26

# What is read as a number, a unit (after a number) or a name wherever it stands.
NUMBER_WORDS = frozenset(
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces "
    "oz pound pounds lb lbs ml l litre litres liter liters gallon gallons second seconds sec minute minutes min hour "
    "hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree "
    "degrees meter meters metre metres kilometer kilometers kilometre kilometres mph kmh hz khz mhz ghz kb mb gb tb "
    "watt watts kw kwh volt volts joule joules newton newtons pascal pascals kelvin celsius fahrenheit".split()
)
NAMES = frozenset(
    "alice bob carol david emma frank grace henry isabel jack james john julia kate laura lily linda lisa lucas lucy "
    "maria mark mary michael mike natalie nina oliver olivia paul peter rachel robert ryan sam sarah sophia steve "
    "susan thomas tom victor william anna ben charlie daniel ella ethan george hannah jane jason jessica".split()
)

_SPECIAL = NUMBER_WORDS | UNITS
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[^\W\d_]{0,3}\d[\d.,:/]*[^\W\d_]{0,3}")
_SALT = {"number": 1, "unit": 2, "name": 3}
#: ``str.split`` parts words here, so no token holds it.
_BETWEEN = "\x1f"
#: Stands for a line end among the words: a sentence may start after it.
_LINE = "\x00"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


#: Facts about a word, as bits: a number, may be a unit, a name, capitalised, may end a sentence, surely does.
_NUMBER_BIT, _UNIT_BIT, _NAME_BIT, _CAPITAL_BIT, _MAY_END_BIT, _ENDS_BIT = (1 << k for k in range(6))


def _token(word: str) -> tuple[str, int, int]:
    """Core of a word, its hash, and what is known of it."""
    if word.isalpha() and word.islower() and word not in _SPECIAL and word == word.lower():
        return word, xxhash.xxh64_intdigest(word.encode()), 0
    core = word.strip(punctuation)
    # Letters alone, as most words are: there is nothing left to strip, and no digit.
    letters = core.isalpha()
    core = core if letters else _EDGES.sub("", word)
    low = core.lower()
    facts = 0
    if low in NUMBER_WORDS or not letters and _NUMBER.fullmatch(core):
        facts |= _NUMBER_BIT
    if low in UNITS:
        facts |= _UNIT_BIT
    if core[:1].isupper() and core[1:] == core[1:].lower():
        facts |= _CAPITAL_BIT | _NAME_BIT * (low in NAMES)
    if not letters or len(core) < len(word):
        bare = word.rstrip("\"')]*")
        if word == _LINE or bare.endswith((".", "!", "?", ":")):
            facts |= _MAY_END_BIT
        if bare.endswith(("!", "?", ":")) or bare.endswith(".") and (facts & _NUMBER_BIT or len(low) > 3):  # "St." may go on
            facts |= _ENDS_BIT
    return low, xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")), facts


def _words(text: str) -> list[str]:
    return text.replace("\n", f" {_LINE} ").split()


class Windows(NamedTuple):
    """Windows of several texts; ``kinds`` and ``codes`` are by token, the rest but ``tokens`` and ``cores`` by window."""

    tokens: np.ndarray  # of each text
    owner: np.ndarray
    position: np.ndarray
    hashes: np.ndarray
    at: np.ndarray  # first token, counted over all texts
    kinds: np.ndarray
    codes: np.ndarray  # of the tokens' first words
    cores: np.ndarray
    runs: dict  # lower-case cores of runs, joined by blanks
    either: np.ndarray  # whether a word stands in it that is read both ways

    def slots(self, width: int, chosen: np.ndarray) -> pd.Series:
        """Slots of the chosen windows, as ``offset:kind:value`` parted by a character that no token holds."""
        out = []
        for a in self.at[chosen].tolist():
            filled = np.nonzero(self.kinds[a : a + width])[0].tolist()
            out.append(_BETWEEN.join(f"{j}:{self.kinds[a + j]}:{self.value(a + j)}" for j in filled))
        return pd.Series(out, dtype=object)

    def value(self, token: int) -> str:
        """Lower-case core of a token, of a run joined by blanks."""
        return self.runs.get(token) or self.cores[self.codes[token]]


class Reading(NamedTuple):
    """Words of several texts, by word but ``cores`` and ``plain``."""

    texts: int
    owner: np.ndarray
    codes: np.ndarray
    cores: np.ndarray
    plain: np.ndarray
    number: np.ndarray
    unit: np.ndarray
    named: np.ndarray  # a name wherever it stands
    capital: np.ndarray
    starts: np.ndarray  # a sentence may start here
    breaks: np.ndarray  # a sentence surely starts here


def read(texts: list[str]) -> Reading:
    """What is known of the words of each text; punctuation alone is none."""
    counts, codes, distinct = coded_words(texts, _words)
    found = list(zip(*map(_token, distinct), strict=True)) or [(), (), ()]
    cores = np.array([*found[0], None], dtype=object)[:-1]
    plain = np.fromiter(found[1], np.uint64, len(distinct))
    flags = np.fromiter(found[2], np.uint8, len(distinct))
    owner = np.repeat(np.arange(len(texts)), counts)
    if not len(codes):
        none = np.zeros(0, dtype=bool)
        return Reading(len(texts), owner, np.zeros(0, dtype=np.int64), cores, plain, none, none, none, none, none, none)
    real = np.nonzero((cores != "")[codes])[0]
    starts = np.ones(len(codes), dtype=bool)
    starts[1:] = (flags[codes[:-1]] & _MAY_END_BIT > 0) | (owner[1:] != owner[:-1])
    ends = np.concatenate(([0], np.cumsum(flags[codes] & _ENDS_BIT > 0)))
    breaks = np.ones(len(real), dtype=bool)
    breaks[1:] = (ends[real[1:]] > ends[real[:-1]]) | (owner[real[1:]] != owner[real[:-1]])
    owner, codes, starts = owner[real], codes[real], starts[real]
    own = flags[codes]
    number = own & _NUMBER_BIT > 0
    unit = np.zeros(len(codes), dtype=bool)
    unit[1:] = (own[1:] & _UNIT_BIT > 0) & number[:-1] & (owner[1:] == owner[:-1])
    return Reading(len(texts), owner, codes, cores, plain, number, unit, own & _NAME_BIT > 0, own & _CAPITAL_BIT > 0, starts, breaks)


def _chained(names: np.ndarray, at: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of ``width`` names from each place on."""
    out = np.full(len(at), np.uint64(seed + 1))
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * _ODD + (names[j : j + len(at)] if len(at) == len(names) - width + 1 else names[at + j])
        return _mix(_mix(out))


def windows(texts: list[str] | Reading, width: int, opens: bool = True, names: bool = False) -> Windows:
    """Windows of ``width`` tokens of each text; whether its first word ``opens`` a sentence.

    Numbers in a row are one token, and names. A capitalised word that starts a sentence is
    a plain word, or a name with ``names``. Positions count the tokens of the latter reading
    in either, so that windows of both can be lined up together. Punctuation alone is no
    token; a text with fewer tokens has no window.
    """
    r = texts if isinstance(texts, Reading) else read(texts)
    first_word = np.ones(len(r.codes), dtype=bool)
    first_word[1:] = r.owner[1:] != r.owner[:-1]
    starts = r.starts if opens else r.starts & ~first_word

    def kinds_of(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of the words, and which of them are a token's first."""
        kinds = np.select([r.number, r.unit, ~r.number & ~r.unit & name], [_SALT["number"], _SALT["unit"], _SALT["name"]], 0)
        heads = np.ones(len(kinds), dtype=bool)
        heads[1:] = r.breaks[1:] | (kinds[1:] != kinds[:-1]) | ((kinds[1:] != _SALT["number"]) & (kinds[1:] != _SALT["name"]))
        return kinds, heads

    as_names, name_heads = kinds_of(r.capital)
    kinds, heads = (as_names, name_heads) if names else kinds_of(r.named | r.capital & ~starts)
    twofold = (as_names == _SALT["name"]) & starts & ~r.named
    first = np.nonzero(heads)[0]
    lengths = np.diff(np.concatenate((first, [len(heads)])))
    codes, runs = r.codes[first], {}
    literal = r.plain[codes]
    for k in np.nonzero(lengths > 1)[0].tolist():
        runs[k] = " ".join(r.cores[r.codes[first[k] : first[k] + lengths[k]]])
        literal[k] = xxhash.xxh64_intdigest(runs[k].encode("utf-8", "surrogatepass"))
    place = np.cumsum(name_heads) - 1
    own = np.bincount(r.owner[name_heads], minlength=r.texts)
    either = np.concatenate(([0], np.cumsum(twofold)))
    either = either[first + lengths] - either[first]
    place, owner, kinds = place[first], r.owner[first], kinds[first]
    template = np.where(kinds > 0, _mix(kinds.astype(np.uint64)), literal)
    n = max(0, len(first) - width + 1)
    at = np.arange(n)
    whole = owner[:n] == owner[width - 1 :][:n]
    plain = np.concatenate(([0], np.cumsum(kinds == 0)))
    open_ = np.concatenate(([0], np.cumsum(either)))
    hashes = _chained(template, at, width, 0)
    # Compared literally where too few words are plain.
    few = np.nonzero(plain[width:][:n] - plain[:n] < min(PLAIN, width))[0]
    hashes[few] = _chained(literal, few, width, width)
    hashes, open_ = hashes[whole], (open_[width:][:n] - open_[:n])[whole]
    at = at[whole]
    position = place[at] - (np.cumsum(own) - own)[owner[at]]
    return Windows(own, owner[at], position, hashes, at, kinds, codes, r.cores, runs, open_ > 0)


_ITEM_WINDOWS = "item_id long, width int, n_windows int, at int, hash long, slots string"
_DOC_WINDOWS = "doc_id long, text_hash long, width int, doc_at int, hash long, doc_slots string"


def _batch(schema: str, *columns: pa.Array | np.ndarray | pd.Series) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of every benchmark item; an item of fewer tokens is one window of its own width.

    The first word is read both as the first of a sentence and as one inside, as an item
    may stand anywhere in a document, and capitalised words that start a sentence as names.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_numpy(zero_copy_only=False)
            for first, held in chunks(Texts(batch.column("text")), SMALL_CHUNK_CHARS):
                words = read(held)
                for width, (opens, names) in product(range(1, window + 1), ((True, False), (False, False), (True, True))):
                    w = windows(words, width, opens, names)
                    size = w.tokens[w.owner]
                    keep = np.nonzero((size == width if width < window else size >= window) & (w.position <= size - width))[0]
                    found = (ids[first + w.owner[keep]], np.full(len(keep), width), size[keep] - width + 1, w.position[keep])
                    yield _batch(_ITEM_WINDOWS, *found, w.hashes[keep].view(np.int64), w.slots(width, keep))

    texts = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return texts.mapInArrow(cut, _ITEM_WINDOWS).dropDuplicates(["item_id", "n_windows", "at", "hash", "slots"])


def window_filter(items: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of the hashes' top bits; at most ``2^bits / 64`` words come to the driver."""
    top = F.shiftrightunsigned("hash", 64 - bits)
    words = items.select(F.shiftright(top, 6).alias("word"), top.alias("top")).groupBy("word")
    found = words.agg(F.expr("bit_or(shiftleft(1L, CAST(top & 63 AS INT)))").alias("bits")).toPandas()
    bitmap = np.zeros((1 << bits) // 64, dtype=np.uint64)
    bitmap[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return bitmap


def candidate_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Windows of documents whose hash may be that of an item's window."""
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # five at most
    bitmap = docs.sparkSession.sparkContext.broadcast(window_filter(items))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("text_hash")
            for first, held in chunks(Texts(batch.column("text")), SMALL_CHUNK_CHARS):
                words = read(held)
                for width, names in product(widths, (False, True)):
                    w = windows(words, width, names=names)
                    top = w.hashes >> np.uint64(64 - FILTER_BITS)
                    known = bits[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))
                    hit = known & np.uint64(1) > 0
                    hit = np.nonzero(hit & w.either if names else hit)[0]
                    if len(hit):
                        rows = pa.array(first + w.owner[hit])
                        found = (ids.take(rows), marks.take(rows), np.full(len(hit), width), w.position[hit])
                        yield _batch(_DOC_WINDOWS, *found, w.hashes[hit].view(np.int64), w.slots(width, hit))

    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return keyed.mapInArrow(cut, _DOC_WINDOWS)


def _filled(at: int, item_slots: str, doc_slots: str) -> list[tuple[str, str]]:
    """Each slot of an item's window with the value that the document gives it."""
    if not item_slots or not doc_slots:
        return []
    values = {offset: value for offset, _, value in (b.split(":", 2) for b in doc_slots.split(_BETWEEN))}
    pairs = []
    for offset, slot in (a.split(":", 1) for a in item_slots.split(_BETWEEN)):
        value = values.get(offset)
        # No slot there, or a run that the document began before the item, says nothing.
        if value is not None and not (at == 0 and offset == "0" and value.count(" ") > slot.count(" ")):
            pairs.append((slot, value))
    return pairs


def _meanings(pairs: Iterator[list[tuple[str, str]]]) -> dict[str, str]:
    """The value that most windows give each slot; of equally many the first."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for filled in pairs:
        for slot, value in filled:
            votes[slot][value] += 1
    return {slot: max(by, key=by.get) for slot, by in votes.items()}


class _Shared(NamedTuple):
    """A window that a document shares with an item."""

    start: int
    doc_at: int
    at: int
    slots: str
    doc_slots: str


def _align(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Best place of one item in one document: windows that start the item at nearly the same token."""
    columns = [rows[c].tolist() for c in ("doc_at", "at", "slots", "doc_slots", "n_windows", "width")]
    listed = sorted((_Shared(d - a, d, a, x or "", y or ""), n, w) for d, a, x, y, n, w in zip(*columns, strict=True))
    _, total, width = listed[0]
    drift = max(2, total // 5)
    places: list[list[_Shared]] = []
    for shared, _, _ in listed:
        if not places or shared.start - places[-1][-1].start > drift:
            places.append([])
        places[-1].append(shared)
    best = None
    for own in places:
        seen: dict = {}
        held, spans, refused = set(), [], set()
        lined = [(row, _filled(row.at, row.slots, row.doc_slots)) for row in sorted(own, key=lambda r: (r.doc_at, r.at))]
        meant = _meanings(filled for _, filled in lined)
        for row, filled in lined:
            if all(meant[slot] == value for slot, value in filled):
                seen.update(filled)
                held.add(row.at)
                spans.append((row.doc_at, row.at))
            else:
                refused.add((row.doc_at, row.at))
        run = longest = 0
        last = None
        for spot in sorted(set(spans), key=lambda s: (s[1] - s[0], s[0])):
            run = run + 1 if last == (spot[0] - 1, spot[1] - 1) else 1
            longest, last = max(longest, run), spot
        if not held:
            continue
        conflicts = len(refused.difference(spans))
        changed = any(k.split(":", 1)[1] != v for k, v in seen.items())
        found = (len(held) / total, longest + width - 1, min(s[0] for s in spans), max(s[0] for s in spans) + width, conflicts, changed)
        best = max(best, found) if best else found
    names = ["doc_id", "text_hash", "item_id", "coverage", "run", "first_token", "end_token", "conflicts", "changed"]
    return pd.DataFrame([(*key, *best)] if best else [], columns=names)


_MATCHES = (
    "doc_id long, text_hash long, item_id long, coverage double, run int, first_token int, end_token int, conflicts int, changed boolean"
)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, run: int = RUN, window: int = WINDOW
) -> DataFrame:
    """Documents (``doc_id, text``) that hold a benchmark item (``item_id, text``).

    Returns a row for each such pair: ``doc_id, text_hash`` (xxhash64 of the text),
    ``item_id, coverage`` (share of the item's windows), ``run`` (tokens in a row),
    ``first_token, end_token`` (where the best place lies, numbers or names in a row being
    one token), ``conflicts`` (windows that
    would give a slot another value, not counted) and ``changed`` (the slots are filled
    otherwise than in the item). Rows equal in id and text are reported once, a null id
    as null. Null and empty texts and items hold nothing, items without an id are passed
    over, items of one id are joined as one. Other columns are not carried.
    """
    items = stored(item_windows(benchmark, window), "item-windows")
    hits = stored(candidate_windows(docs, items), "window-hits")
    pairs = hits.join(items, ["hash", "width"]).dropDuplicates(["doc_id", "text_hash", "item_id", "doc_at", "at", "slots", "doc_slots"])
    pairs = stored(pairs.drop("hash"), "window-pairs")
    key = ["doc_id", "text_hash", "item_id"]
    enough = pairs.groupBy(*key).agg(
        F.count_distinct("at").alias("held"), F.max("n_windows").alias("total"), F.max("width").alias("size")
    )
    enough = enough.where((F.col("held") >= F.col("total") * coverage) | (F.col("held") >= run - F.col("size") + 1)).select(*key)
    same = F.expr("p.doc_id <=> e.doc_id AND p.text_hash = e.text_hash AND p.item_id = e.item_id")
    chosen = pairs.alias("p").join(enough.alias("e"), same, "left_semi")
    found = chosen.groupBy(*key).applyInPandas(_align, _MATCHES)
    return found.where((F.col("coverage") >= coverage) | (F.col("run") >= run))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")
