"""Language identification by character models with interpolated Kneser-Ney smoothing.

Texts become sequences of lower-case letters, with a blank for each run of other characters,
and a border of ``ORDER - 1`` marks in front. Each language has a model of ``ORDER``
characters: counts less a discount at the highest order, the numbers of different characters
in front below it, and at every order the weight that the discount frees goes to the next
shorter context.

The models are stored together. Per order there is one sorted array of the hashes of all
character sequences that any language has, and beside it the log probability under each
language; a second pair of arrays holds the weights of the contexts. A text is looked up
from the longest sequences down, so what is found there is not looked up any further. The
lowest cross-entropy per character wins.

Every labelled text is learned from, and every sequence is kept. Confidence and rejection
are calibrated on every labelled text as well, by models that have not seen it: the texts fall
into two halves by a hash, and each half is scored under models of the other. The score is the
share of the winner when cross-entropies compete under a fitted sharpness, and a text is
accepted if its cross-entropy is within what ``USUAL`` of its language's rows have.

Models of more than ``LARGEST`` sequences are fitted and met in parts, one at a time: for some
languages, all places after some characters. A place is looked up in the part of the character
in front, which holds all sequences and contexts it can need, so the parts' cross-entropies add
up to those of whole models. Each part costs a pass over the texts; a single character's
sequences are not divided further.

Rules: null texts and texts without a letter get ``UNKNOWN``, score 0 and are not accepted;
equal cross-entropies go to the language first in order; without labelled rows every text
is unknown; repeated rows count as often as they are there and are scored alike; a language
all of whose texts are in one half accepts every text; an empty table gives no rows. Columns of the
frame with the name of a result are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.batches import pieces, quoted, with_results
from colonnade.operators.ranks import values_at_ranks
from colonnade.scratch import written
from colonnade.small import small_table

ORDER = 5
#: Sequences (a row per language) and languages of one part of the models.
LARGEST, TOGETHER = 2_000_000, 16
#: Different sequences that a task counts before it passes them on.
COUNTED = 1 << 19
#: The share of a language's rows that is accepted; sharpnesses that are tried.
USUAL, SHARPNESSES = 0.995, 2.0 ** np.arange(-2, 8)
#: Cross-entropies that one task may sort.
RANK_BUFFER = 20_000
UNKNOWN = "und"
BLANK, SLACK = 32, 0.05
LETTER = regex.compile(r"\p{L}")
#: Characters that are looked up at a time; longer texts go in parts.
PART = 1 << 19
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Alphabet:
    """Code points as models see them, worked out for those that occur."""

    def __init__(self):
        self.shown = np.full(0x110000, -1, np.int32)

    def sequences(self, texts: list[str], tails: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts one after another, each with its border in front; the places of their
        own characters; and where in these places each text begins, with the end. ``tails``:
        for texts that go on, what their ``ORDER - 1`` characters before were."""
        lengths = np.array([len(t) for t in texts])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        for code in np.unique(codes[self.shown[codes] < 0]).tolist():
            lettered = unicodedata.category(chr(code))[0] in "LM"
            self.shown[code] = ord(chr(code).lower()[0]) if lettered else BLANK
        tails = np.zeros((len(texts), ORDER - 1), np.uint64) if tails is None else tails
        shown = self.shown[codes]
        document = np.repeat(np.arange(len(texts)), lengths)
        before = np.full(len(shown), BLANK, np.int32)
        before[1:] = shown[:-1]
        last = tails[:, -1].astype(np.int32)
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = np.where(last, last, BLANK)[lengths > 0]
        kept = (shown != BLANK) | (before != BLANK)
        shown, document = shown[kept], document[kept]
        places = np.arange(len(shown)) + (ORDER - 1) * (document + 1)
        starts = np.searchsorted(document, np.arange(len(texts) + 1))
        sequence = np.zeros(len(shown) + (ORDER - 1) * len(texts), np.uint64)
        sequence[places] = shown
        first = starts[:-1] + (ORDER - 1) * np.arange(len(texts))
        for i in range(ORDER - 1):
            sequence[first + i] = tails[:, i]
        return sequence, places, starts

    def stretches(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """Sequences of no more than about ``PART`` characters at a time, with the numbers of
        their texts; longer texts go in several. Texts without a letter are passed over."""
        waiting: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text or not LETTER.search(text):
                continue
            if len(text) > PART:
                tail = None
                for start in range(0, len(text), PART):
                    found = self.sequences([text[start : start + PART]], tail)
                    tail = found[0][None, -(ORDER - 1) :]
                    yield [i], *found
                continue
            if size + len(text) > PART:
                yield waiting, *self.sequences([texts[k] for k in waiting])
                waiting, size = [], 0
            waiting.append(i)
            size += len(text)
        if waiting:
            yield waiting, *self.sequences([texts[k] for k in waiting])


def hashes(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of character columns, as a rolling hash over them would give."""
    value = np.zeros(len(columns[0]) if columns else 1, np.uint64)
    for column in columns:
        value = value * _FACTOR + column.astype(np.uint64) + np.uint64(1)
    return _mixed(value)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * _MIX
    return value ^ (value >> np.uint64(29))


def rolling(sequence: np.ndarray) -> list[np.ndarray]:
    """For each order from 0 up, the hash of the characters up to each place."""
    value, found = np.zeros(len(sequence), np.uint64), []
    for _ in range(ORDER + 1):
        found.append(_mixed(value))
        moved = np.zeros(len(sequence), np.uint64)
        moved[1:] = value[:-1]
        value = moved * _FACTOR + sequence + np.uint64(1)
    return found


class Hashes:
    """Sorted hashes, with the place at which those with equal first bits begin."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def place(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int32), np.zeros(len(wanted), bool)
        last = len(self.keys) - 1
        at = np.minimum(self.starts[wanted >> self.shift], last)
        met = self.keys[at]
        left = np.flatnonzero((met < wanted) & (at < last))
        while len(left):
            at[left] += 1
            met[left] = self.keys[at[left]]
            left = left[(met[left] < wanted[left]) & (at[left] < last)]
        return at, met == wanted


@dataclass
class Level:
    """One order: sorted hashes with log probabilities, and of contexts with log weights."""

    keys: Hashes
    logs: np.ndarray
    contexts: Hashes
    weights: np.ndarray


@dataclass
class Whole:
    """What a part must know of all parts: by language and order the numbers of sequences
    counted once and twice, by language the last characters with the number of different
    ones in front, and the number of last characters of all languages."""

    few: dict[tuple[str, int], tuple[int, int]]
    singles: dict[str, tuple[np.ndarray, np.ndarray]]
    characters: int


@dataclass
class Part:
    """The counts of some languages after some characters. ``others``: after all but these."""

    counts: DataFrame | None
    languages: list[str]
    characters: np.ndarray | None = None
    others: bool = False
    whole: Whole | None = None


@dataclass
class Models:
    languages: list[str]
    levels: list[Level] = field(default_factory=list)  # from order 1 up
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sharpness: float = 1.0
    usual: dict[str, float] = field(default_factory=dict)
    parts: list[Part] = field(default_factory=list)  # instead of levels, where these are too many
    part: Part | None = None  # the part that this is

    def entropies(self, texts: list[str | None], alphabet: Alphabet) -> np.ndarray:
        """Cross-entropy per character of each text under each language, NaN without a
        letter."""
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for numbers, sequence, places, starts in alphabet.stretches(texts):
            sums[numbers] += self._sums(sequence, places, starts)
            sizes[numbers] += np.diff(starts)
        sizes[sizes == 0] = np.nan
        return -sums / sizes[:, None]

    def _sums(self, sequence: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log probabilities summed by text."""
        logs = np.zeros((len(places), len(self.languages)))
        prefixes = rolling(sequence)
        left = np.arange(len(places))
        if self.part and self.part.characters is not None:
            left = np.flatnonzero(np.isin(sequence[places - 1], self.part.characters) != self.part.others)
        for order in range(ORDER, 0, -1):
            level = self.levels[order - 1]
            at, met = level.keys.place(prefixes[order][places[left]])
            logs[left[met]] += level.logs[at[met]]
            left = left[~met]
            at, met = level.contexts.place(prefixes[order - 1][places[left] - 1])
            logs[left[met]] += level.weights[at[met]]
        logs[left] += self.unseen
        full = np.diff(starts) > 0
        sums = np.zeros((len(full), len(self.languages)))
        if full.any():
            sums[full] = np.add.reduceat(logs, starts[:-1][full], axis=0)
        return sums

    def shares(self, entropies: np.ndarray) -> np.ndarray:
        ahead = np.exp(-self.sharpness * (entropies - entropies.min(axis=1, keepdims=True)))
        return ahead / ahead.sum(axis=1, keepdims=True)


def fitted(grams: dict[str, tuple[np.ndarray, np.ndarray]], whole: Whole | None = None) -> Models:
    """Models from each language's sequences (rows of ``ORDER`` characters) and counts.
    ``whole``: they are those after some characters only, and what to know of the others."""
    languages = sorted(grams)
    own: list[list[tuple[np.ndarray, np.ndarray]]] = [[grams[name]] for name in languages]
    for name, chain in zip(languages, own):
        for _ in range(ORDER - 1):  # different characters in front of each shorter sequence
            rows = chain[0][0][:, 1:]
            _, first, count = np.unique(hashes(list(rows.T)), return_index=True, return_counts=True)
            chain.insert(0, (rows[first], count))
        if whole:
            chain[0] = whole.singles[name]
    models = Models(languages)
    lower_keys, lower = hashes([]), None
    for order in range(1, ORDER + 1):
        hashed = [hashes(list(chain[order - 1][0].T)) for chain in own]
        rows = np.concatenate([chain[order - 1][0] for chain in own])
        keys, first = np.unique(np.concatenate(hashed), return_index=True)
        rows = rows[first]
        contexts, context = np.unique(hashes(list(rows[:, :-1].T)) if order > 1 else np.zeros(len(rows), np.uint64), return_inverse=True)
        if lower is None:
            characters = whole.characters if whole else len(rows)
            spread = np.full((len(rows), len(languages)), 1.0 / (characters + 1))
        else:
            spread = lower[np.searchsorted(lower_keys, hashes(list(rows[:, 1:].T)))]
        probability, weight = np.empty_like(spread), np.ones((len(contexts), len(languages)))
        for n, (name, chain, own_hashes) in enumerate(zip(languages, own, hashed)):
            counts = np.zeros(len(keys))
            counts[np.searchsorted(keys, own_hashes)] = chain[order - 1][1]
            once, twice = whole.few[name, order] if whole else (np.count_nonzero(counts == 1), np.count_nonzero(counts == 2))
            discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
            total = np.bincount(context, counts, len(contexts))
            kinds = np.bincount(context, counts > 0, len(contexts))
            known = total > 0
            weight[known, n] = discount * kinds[known] / total[known]
            seen = np.maximum(counts - discount, 0) / np.where(known, total, 1)[context]
            probability[:, n] = seen + weight[context, n] * spread[:, n]
        if order == 1:
            models.unseen = np.log(np.full(len(languages), 1.0 / (characters + 1)))
            contexts = hashes([])  # the empty context, met everywhere
        logs, weights = np.log(probability).astype(np.float32), np.log(weight).astype(np.float32)
        models.levels.append(Level(Hashes(keys), logs, Hashes(contexts), weights))
        lower_keys, lower = keys, probability
    return models


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """About ``most`` sequences per language: those counted more often than a least number,
    and of those counted as often as that a share by their hash."""
    taken: dict[str, tuple[int, int, float]] = {}
    for row in sorted(counts.groupBy("lang", "n").count().collect(), key=lambda r: (r["lang"], -r["n"])):
        so_far, *_ = taken.get(row["lang"], (0, 0, 0.0))
        if so_far < most:
            share = min(1.0, (most - so_far) / row["count"])
            taken[row["lang"]] = so_far + row["count"], row["n"], share
    least = small_table(counts.sparkSession, [(k, n, s * (1 << 40)) for k, (_, n, s) in taken.items()], "lang string, least long, share double")
    lot = F.pmod(F.xxhash64("gram"), F.lit(1 << 40))
    chosen = (F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & (lot < F.col("share")))
    return counts.join(least, "lang").where(chosen).select("lang", "gram", "n")


def sequence_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n0, n1) of all sequences of ``ORDER`` characters in (lang, text, half):
    how often they are in either half."""
    counted = labelled.select("lang", "text", "half").mapInArrow(_counted, "lang string, gram string, n0 long, n1 long")
    return counted.groupBy("lang", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _counted(batches: Iterator[pa.RecordBatch], room: int = COUNTED) -> Iterator[pa.RecordBatch]:
    """A task's counts, passed on whenever they are of more than ``room`` sequences."""
    alphabet = Alphabet()
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0
    for piece in pieces(batches, "text"):
        own: dict[tuple[str, int], list[str]] = {}
        for name, text, half in zip(*(piece.column(i).to_pylist() for i in range(3))):
            own.setdefault((name, half), []).append(text)
        for (name, half), texts in own.items():
            for _, sequence, places, _ in alphabet.stretches(texts):
                points = sequence.astype("<u4")
                rows, count = _summed(np.stack([points[places - back] for back in range(ORDER - 1, -1, -1)], axis=1))
                if not len(rows):
                    continue
                number = np.zeros((len(rows), 2), np.int64)
                number[:, half] = count
                found.setdefault(name, []).append((rows, number))
                size += len(rows)
                if size > room:
                    found = _merged(found)
                    size = sum(len(held[0][0]) for held in found.values())
                if size > room:
                    yield from _batches(found)
                    found, size = {}, 0
    yield from _batches(_merged(found))


def _summed(rows: np.ndarray, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different rows with their summed numbers, or how often they are there."""
    hashed = hashes(list(rows.T))
    if number is None:
        _, first, count = np.unique(hashed, return_index=True, return_counts=True)
        return rows[first], count
    order = np.argsort(hashed, kind="stable")
    starts = np.flatnonzero(np.diff(hashed[order], prepend=~hashed[order[:1]]))
    return rows[order[starts]], np.add.reduceat(number[order], starts)


def _merged(found: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    return {name: [_summed(*map(np.concatenate, zip(*held)))] for name, held in found.items()}


def _batches(found: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for name, held in found.items():
        for rows, number in held:
            grams = np.ascontiguousarray(rows).view(f"<U{ORDER}")[:, 0].tolist()
            columns = [pa.array([name] * len(grams)), pa.array(grams), pa.array(number[:, 0]), pa.array(number[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n0", "n1"])


def _points(texts: pa.ChunkedArray, width: int) -> np.ndarray:
    """The characters of texts of ``width``, a row each."""
    found = [np.frombuffer("".join(chunk.to_pylist()).encode("utf-32-le"), "<u4") for chunk in texts.chunks]
    return np.concatenate([np.zeros(0, "<u4"), *found]).reshape(-1, width)


def _by_language(table: pa.Table, width: int, languages: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each language's sequences and counts."""
    names, number = table["lang"].to_numpy(), table["n"].to_numpy()
    rows = _points(table["gram"], width)
    return {name: (rows[names == name], number[names == name]) for name in languages}


def _whole(counts: DataFrame) -> Whole:
    """Sequences of every order from the counts (lang, gram, n) of the longest."""
    few: dict[tuple[str, int], tuple[int, int]] = {}
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            counts = counts.groupBy("lang", F.substring("gram", 2, ORDER).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        seen = counts.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
        few |= {(r["lang"], order): (r["once"], r["twice"]) for r in seen.collect()}  # a row per language
    singles = _by_language(counts.toArrow(), 1, sorted({name for name, _ in few}))  # a row per language and character
    return Whole(few, singles, len(np.unique(np.concatenate([rows for rows, _ in singles.values()]))))


def _loaded(part: Part) -> Models:
    models = fitted(_by_language(part.counts.toArrow(), ORDER, part.languages), part.whole)
    models.part = replace(part, counts=None, whole=None)  # without what tasks cannot take
    return models


def _models(counts: DataFrame, number: Column, most: int | None) -> Models:
    """Models from counts, of which ``number`` is what counts; in parts if they are many."""
    counts = counts.select("lang", "gram", number.alias("n")).where("n > 0")
    if most is not None:
        counts = written(_most_frequent(counts, most))
    before = F.substring("gram", ORDER - 1, 1)
    # A row per language and character
    sizes = [(r["lang"], r["c"], r["n"]) for r in counts.groupBy("lang", before.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()]
    languages = sorted({name for name, _, _ in sizes})
    if not languages:
        return Models([])
    if sum(n for _, _, n in sizes) <= LARGEST and len(languages) <= TOGETHER:
        return _loaded(Part(counts, languages))
    whole, parts = _whole(counts), []
    for start in range(0, len(languages), TOGETHER):
        own = languages[start : start + TOGETHER]
        total: dict[str, int] = {}
        for name, c, n in sizes:
            if name in own:
                total[c] = total.get(c, 0) + n
        shares: list[list[str]] = []
        room = 0
        for c, n in sorted(total.items(), key=lambda item: (-item[1], item[0])):
            if not shares or n > room:
                shares.append([])
                room = LARGEST
            shares[-1].append(c)
            room -= n
        for k, share in enumerate(shares):
            # The last part, of the rarest characters, has the places after characters of no part
            last = k == len(shares) - 1
            marks = [c for other in shares[:-1] for c in other] if last else share
            held = counts.where(F.col("lang").isin(own))
            held = held.where(before.isin(marks) != last) if marks else held
            parts.append(Part(held, own, np.array([ord(c) for c in marks], np.uint64), last, whole))
    return Models(languages, parts=parts)


def train(frame: DataFrame, text: str = "text", label: str = "lang", most: int | None = None) -> Models:
    """Models from all rows of ``frame`` with a text and a label. ``most``: keep about as many
    sequences per language, the most frequent ones; all are kept by default."""
    given = frame.select(frame[quoted(text)].alias("text"), frame[quoted(label)].cast("string").alias("lang"))
    labelled = given.where("text IS NOT NULL AND lang IS NOT NULL")
    labelled = labelled.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))  # equal texts go together
    counts = written(sequence_counts(labelled))
    models = _models(counts, F.col("n0") + F.col("n1"), most)
    halves = ((_models(counts, F.col(f"n{1 - half}"), most), labelled.where(F.col("half") == half)) for half in (0, 1))
    return calibrated(models, halves)


def calibrated(models: Models, given: Iterable[tuple[Models, DataFrame]]) -> Models:
    """The sharpness under which the rows' own languages are likeliest, and per language
    the cross-entropy up to which ``USUAL`` of its rows are. ``given``: models with rows
    (lang, text) that these have not seen."""
    scored = [written(_placed(models, other, rows)) for other, rows in given if other.languages]
    if not scored:
        return models
    entries = reduce(DataFrame.union, scored)
    likely = entries.agg(*[F.avg(F.col("likely")[i]) for i in range(len(SHARPNESSES))]).first()
    best = -np.inf
    for sharpness, found in zip(SHARPNESSES, likely):
        if found is None or found <= best:
            break
        models.sharpness, best = float(sharpness), found
    sizes = {r["group"]: r["count"] for r in entries.groupBy("group").count().collect()}  # a row per language
    ranks = {group: (USUAL * (n - 1), int(USUAL * (n - 1)), min(n - 1, int(USUAL * (n - 1)) + 1)) for group, n in sizes.items()}
    targets = {group: sorted({low, high}) for group, (_, low, high) in ranks.items()}
    values = values_at_ranks(entries.select("group", "key", F.lit(1).alias("n")), targets, sizes, RANK_BUFFER, unit=True) if sizes else {}
    for group, (place, low, high) in ranks.items():
        usual = values[group, low] + (place - low) * (values[group, high] - values[group, low])
        models.usual[models.languages[group]] = usual * (1 + SLACK)
    return models


def _placed(models: Models, other: Models, rows: DataFrame) -> DataFrame:
    """(group, key, likely) of rows in a language that the other models know: its number, the
    cross-entropy under it, and the log likelihood of it under every sharpness."""
    known = [(name, models.languages.index(name), i) for i, name in enumerate(other.languages)]
    places = small_table(rows.sparkSession, known, "lang string, `group` int, at int")
    found = _with_entropies(rows, other, "text", ["lang"]).where("entropies IS NOT NULL").join(F.broadcast(places), "lang")
    found = found.withColumn("key", F.get("entropies", F.col("at"))).withColumn("least", F.array_min("entropies"))

    def likelihood(sharpness: float) -> Column:
        ahead = F.transform("entropies", lambda e: F.exp((F.col("least") - e) * sharpness))
        total = F.aggregate(ahead, F.lit(0.0), lambda a, e: a + e)
        return F.greatest((F.col("least") - F.col("key")) * sharpness - F.log(total), F.lit(float(np.log(1e-12))))

    return found.select("group", "key", F.array(*[likelihood(float(s)) for s in SHARPNESSES]).alias("likely"))


def _with_entropies(frame: DataFrame, models: Models, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``entropies``, the cross-entropy under each language or null."""
    fields = [("entropies", T.ArrayType(T.DoubleType()))]
    if not models.parts:
        return with_results(frame, text, fields, _entropies_of(models), keep)
    # A part at a time is held by the driver; equal texts have equal results
    digest = F.sha2(frame[quoted(text)].cast("binary"), 256).alias("digest")
    texts = frame.where(frame[quoted(text)].isNotNull()).select(digest, frame[quoted(text)].alias("text"))
    passes = []
    for number, part in enumerate(models.parts):
        places = [models.languages.index(name) for name in part.languages]
        own = with_results(texts, "text", fields, _entropies_of(_loaded(part), places, len(models.languages)), ["digest"])
        passes.append(written(own.where("entropies IS NOT NULL").select("digest", F.lit(number).alias("part"), "entropies")))
    once = reduce(DataFrame.union, passes).groupBy("digest", "part").agg(F.first("entropies").alias("entropies"))
    by_part = F.array_sort(F.collect_list(F.struct("part", "entropies")))
    zero = F.array_repeat(F.lit(0.0), len(models.languages))
    total = F.aggregate(by_part, zero, lambda a, p: F.zip_with(a, p["entropies"], lambda x, y: x + y))
    sums = once.groupBy("digest").agg(total.alias("entropies"))
    kept = frame.select(*[frame[quoted(c)].alias(f"c{i}") for i, c in enumerate(keep)], digest)
    return kept.join(sums, "digest", "left").drop("digest").toDF(*keep, "entropies")


def _entropies_of(models: Models, places: list[int] | None = None, width: int = 0):
    def make():
        alphabet = Alphabet()

        def work(texts):
            found = models.entropies(texts, alphabet)
            if places is not None:  # among those of all languages
                own, found = found, np.zeros((len(texts), width))
                found[:, places] = own
            return ([None if np.isnan(e).any() else e.tolist() for e in found],)

        return work

    return make


def with_language(frame: DataFrame, models: Models, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The frame (or its columns ``keep``) with ``lang_pred``, ``score`` (0 to 1),
    ``cross_entropy`` (null where unknown) and ``accepted``."""
    fields = [
        ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("accepted", T.BooleanType()),
    ]
    names = models.languages
    usual = np.array([models.usual.get(name, np.inf) for name in names])
    shares = replace(models, parts=[]).shares

    def verdicts(found):
        if not names:
            return [UNKNOWN] * len(found), [0.0] * len(found), [None] * len(found), [False] * len(found)
        known = ~np.isnan(found[:, 0])
        filled = np.where(known[:, None], found, 0.0)
        best, row = filled.argmin(axis=1), np.arange(len(found))
        least, share = filled[row, best], shares(filled)[row, best]
        return (
            [names[b] if k else UNKNOWN for b, k in zip(best, known)],
            np.where(known, share, 0.0).tolist(),
            [e if k else None for e, k in zip(least.tolist(), known)],
            (known & (least <= usual[best])).tolist(),
        )

    def make():
        alphabet = Alphabet()
        return lambda texts: verdicts(models.entropies(texts, alphabet) if names else texts)

    if not models.parts:
        return with_results(frame, text, fields, make, keep)
    kept = [c for c in (frame.columns if keep is None else keep) if c not in [name for name, _ in fields]]
    found = _with_entropies(frame, models, text, kept).toDF(*[f"k{i}" for i in range(len(kept))], "entropies")
    unknown = [np.nan] * len(names)
    made = with_results(found, "entropies", fields, lambda: lambda given: verdicts(np.array([e or unknown for e in given])), found.columns[:-1])
    return made.toDF(*kept, *[name for name, _ in fields])
