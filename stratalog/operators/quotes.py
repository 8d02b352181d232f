"""Provenance of quotations: containment, fuzzy match, and n-gram recall within a time window."""

from __future__ import annotations

import difflib
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import ts_to_sec
from ..functions.dialect import fold, strip
from ..functions.text import bigrams, characters, normalize_tokens
from .timeline import cues_near

#: Patterns of anchors and cues, and limits of the checks, fixed values.
MIC = "[🎙🎤]\ufe0f?"
ANCHOR = rf'>[ \t]*\[!quote\][ \t]*{MIC}[ \t]*原片教学锚点[（(]([^\n）)]+)[）)][ \t]*\n>[ \t]*["“]([^"”\n]+)["”][ \t]*\n>[ \t]*——[ \t]*\[([0-9]{{1,3}}:[0-9]{{2}}(?::[0-9]{{2}})?)[ \t]*-[ \t]*([0-9]{{1,3}}:[0-9]{{2}}(?::[0-9]{{2}})?)\]'
MARKER, MENTION = rf"(?m)^>[ \t]*\[!quote\][ \t]*{MIC}[ \t]*原片教学锚点", r"(?m)^>.*原片教学锚点"
CUE = r"\[(\d{1,2}:\d{2}(?::\d{2})?)(?U:\s*)-->(?U:\s*)(\d{1,2}:\d{2}(?::\d{2})?)\](?U:\s*)([^\n]+)"
MAX_ANCHORS, MAX_QUOTE, FUZZY, RECALL = 6, 100, 0.78, 0.55
#: Greatest length of the blocks on which containment candidates meet.
PIECE = 24
#: Bytes of quotes, and for each of them, of which an automaton travels with the tasks; a node, one a character at most, takes some forty.
AUTOMATON_BYTES, QUOTE_BYTES = 1 << 20, 64
#: Quotes that one pass over the texts looks for, and classes of pairs of characters in the filter of a single match.
BLOCK_QUOTES, PAIR_CLASSES = 2000, 1 << 14
#: Of the fuzzy join: needles that stretches are compared with at once, pairs in a tile of that, and characters of text taken at a time.
GROUP_NEEDLES, TILE_PAIRS, TAKEN_CHARACTERS = 256, 4096, 1 << 20


def contained(quotes: DataFrame, docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """(doc_id, quote_id) of folded quotes that are substrings of folded texts, each pair once. Empty folds match nothing.

    The quotes' size is measured. Up to AUTOMATON_BYTES, an automaton of them passes over each text where it lies, and only
    pairs are shuffled. Beyond, texts and quotes meet on blocks, see ``_on_blocks``.
    """
    q = quotes.select("quote_id", fold(F.col("quote")).alias("needle")).where("needle <> ''")
    texts = docs.select("doc_id", fold(F.col("text")).alias("hay")).where("hay <> ''")
    size = q.agg(F.sum((F.octet_length("needle") + QUOTE_BYTES).cast("long"))).first()[0] or 0
    found = _by_automaton(q, texts) if size <= AUTOMATON_BYTES else _on_blocks(q, texts, piece)
    return found.distinct()  # ids that repeat on either side meet once


def _by_automaton(q: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, quote_id) of quotes (quote_id, needle), few enough to travel with the tasks, and texts (doc_id, hay)."""
    held = q.toArrow()
    ids, needles = held.column("quote_id").combine_chunks(), held.column("needle").to_pylist()
    shared = q.sparkSession.sparkContext.broadcast((ids, needles))

    def run(batches):
        ids, needles = shared.value
        own: dict[str, list[int]] = {}
        for i, needle in enumerate(needles):
            own.setdefault(needle, []).append(i)
        automaton = ahocorasick.Automaton()
        for needle, places in own.items():
            automaton.add_word(needle, places)
        if own:
            automaton.make_automaton()
        for batch in batches if own else ():
            rows, found = [], []
            for i, hay in enumerate(batch.column(1).to_pylist()):
                hit = sorted({k for _, places in automaton.iter(hay) for k in places})
                rows += [i] * len(hit)
                found += hit
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), ids.take(pa.array(found, pa.int64()))], ["doc_id", "quote_id"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, quote_id {q.schema['quote_id'].dataType.simpleString()}")


def _on_blocks(q: DataFrame, texts: DataFrame, piece: int) -> DataFrame:
    """(doc_id, quote_id) of quotes (quote_id, needle) and texts (doc_id, hay), by a join.

    Texts are cut in blocks of ``piece`` characters from their start. A quote of 2 * piece - 1 characters or more covers
    a whole block wherever it lies, at one of its first ``piece`` offsets: texts emit their blocks, quotes the pieces at
    those offsets, and the join is an equi-join of hashes; ``contains`` verifies. Shorter quotes meet on shorter blocks.
    """
    q = q.withColumn("len", F.least(F.floor((F.length("needle") + 1) / 2).cast("int"), F.lit(piece)))
    width = F.col("len")
    # The characters are bound as a lambda's variable, so that they are split once, not for every offset.
    starts = F.transform(F.array(characters(F.substring("needle", 1, 2 * piece - 1))), lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), width), lambda i: F.xxhash64(F.array_join(F.slice(c, i, width), "")))))
    asked = q.select("quote_id", "len", F.explode(F.get(starts, F.lit(0))).alias("h"))
    lengths = q.select("len").distinct()  # at most ``piece`` lengths
    blocks = F.regexp_extract_all("hay", F.concat(F.lit("(?s).{"), width.cast("string"), F.lit("}")), F.lit(0))
    pieces = texts.join(F.broadcast(lengths), F.length("hay") >= width).select("doc_id", "len", F.explode(F.array_distinct(F.transform(blocks, lambda x: F.xxhash64(x)))).alias("h"))
    found = pieces.join(asked, ["len", "h"]).select("doc_id", "quote_id").distinct()
    sure = found.join(q.select("quote_id", "needle"), "quote_id").join(texts, "doc_id").where(F.contains("hay", F.col("needle")))
    return sure.select("doc_id", "quote_id")


def recall(cues: DataFrame, windows: DataFrame, margin: float = 25) -> DataFrame:
    """(archive_id, window_id, n_quote, n_hit): of windows (…, s0, e0, quote), how many of the quote's bigrams the cues near it hold, for the best source.

    Sources without a cue there, and quotes of fewer than two characters, have no row.
    """
    near = cues_near(cues, windows, margin)
    said = near.groupBy("archive_id", "source_no", "window_id").agg(F.first("quote").alias("quote"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "cue_no", "text"))), lambda x: x["text"]), " ").alias("said"))
    rows = said.select("archive_id", "window_id", F.size(bigrams(F.col("quote"))).alias("n_quote"), F.size(F.array_intersect(bigrams(F.col("quote")), bigrams(F.col("said")))).alias("n_hit")).where("n_quote > 0")
    return rows.groupBy("archive_id", "window_id").agg(F.max("n_quote").cast("long").alias("n_quote"), F.max("n_hit").cast("long").alias("n_hit"))


def _pairs(text: str) -> np.ndarray:
    """The class of each pair of neighbouring characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (codes[:-1] * 31 + codes[1:]) % PAIR_CLASSES


class _Needle:
    """A normalised quote and what its filters look up."""

    def __init__(self, text: str):
        self.text, pairs = text, _pairs(text)
        classes, self.times = np.unique(pairs, return_counts=True)
        self.place = np.full(PAIR_CLASSES, -1, np.int32)
        self.place[classes] = np.arange(len(classes))
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def common(self, window: str) -> int:
        """Length of the longest common subsequence, by the bits of one integer."""
        n = len(self.text)
        whole = (1 << n) - 1
        v = whole
        for c in window:
            if m := self.masks.get(c):
                u = v & m
                v = ((v + u) | (v - u)) & whole
        return n - v.bit_count()

    def candidates(self, hay: str, hay_pairs: np.ndarray, threshold: float, width: int) -> list[int]:
        """Starts of the windows that hold enough of the needle's pairs of characters to reach the threshold.

        A ratio t of n and w characters needs m >= t(n + w)/2 of them in matching blocks. Between two blocks at least one
        character of either text is left over, so there are at most 1 + n + w - 2m blocks, and a block of k characters has
        k - 1 pairs of the needle's: m - (1 + n + w - 2m) = 3m - n - w - 1 pairs common to both at least, each as often as it
        stands in either. Pairs that merely share a class only add to the count, so no window is lost.
        """
        n = len(self.text)
        starts = np.arange(0, max(1, len(hay) - n + 1), max(1, n // 5))
        ends = np.minimum(starts + width, len(hay))
        need = (1.5 * threshold - 1) * (n + ends - starts) - 1 - 1e-9
        places = self.place[hay_pairs]
        upto = np.concatenate(([0], np.cumsum(places >= 0)))
        last = np.maximum(ends - 1, starts).clip(0, len(upto) - 1)
        some = np.flatnonzero(upto[last] - upto[starts.clip(0, len(upto) - 1)] >= need)
        kept = []
        for at in range(0, len(some), 4096):
            part = some[at : at + 4096]
            lengths = np.maximum(ends[part] - 1 - starts[part], 0)
            row = np.repeat(np.arange(len(part)), lengths)
            where = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[part], lengths)
            found = places[where]
            held = np.bincount(row[found >= 0] * len(self.times) + found[found >= 0], minlength=len(part) * len(self.times)).reshape(len(part), -1)
            kept += starts[part[np.minimum(held, self.times).sum(1) >= need[part]]].tolist()
        return kept

    def width(self, strict: bool) -> int:
        return len(self.text) if strict else len(self.text) + 15

    def near(self, hay: str, threshold: float, strict: bool, low: int = 0, high: int | None = None) -> bool:
        """Whether the ratio of any window, or any that starts in [low, high), reaches the threshold. Matching blocks are a common subsequence, so its length bounds theirs."""
        n = len(self.text)
        if n < 4:
            return False
        width, step = self.width(strict), max(1, n // 5)
        ratio = difflib.SequenceMatcher(None, autojunk=True)
        ratio.set_seq1(self.text)
        starts = self.candidates(hay, _pairs(hay), threshold, width) if high is None else range(-(-low // step) * step, min(high, max(1, len(hay) - n + 1)), step)
        for at in starts:
            window = hay[at : at + width]
            if 2.0 * self.common(window) / (n + len(window)) >= threshold:
                ratio.set_seq2(window)
                if ratio.ratio() >= threshold:
                    return True
        return False


class _Group:
    """Needles of about one length, and the bits by which stretches of text are compared with all of them at once.

    A stretch holds whole all windows that start in its first ``step`` characters. No window has a longer subsequence in
    common with a needle than its stretch has, and a needle's first 64 * words characters lose at most as many matches
    as there are characters behind them. So a stretch whose common subsequence with that head is too short holds no window
    at the threshold. One word is enough while the head has to match for the most part.
    """

    def __init__(self, needles: list[_Needle], numbers: list[int], alphabet: dict[str, int], threshold: float, strict: bool):
        self.numbers = numbers
        n = np.array([len(x.text) for x in needles])
        self.longest = max(x.width(strict) for x in needles)
        self.step = max(1, self.longest * 4 // 5)
        need = lambda w: np.ceil(threshold * (n + w) / 2 - 1e-9)
        self.words = next(k for k in range(1, -(-int(n.max()) // 64) + 1) if 64 * k >= n.max() or np.all(need(n) - np.maximum(n - 64 * k, 0) >= 0.7 * np.minimum(n, 64 * k)))
        # A window that the text's end cuts is as long as the needle at least, or as the text.
        self.behind, self.n, self.threshold = np.maximum(n - 64 * self.words, 0), n, threshold
        self.inner = need(n if strict else n + 15) - self.behind
        self.masks = np.zeros((self.words, len(alphabet) + 1, len(needles)), np.uint64)
        for q, needle in enumerate(needles):
            for i, c in enumerate(needle.text[: 64 * self.words]):
                self.masks[i // 64, alphabet[c], q] |= np.uint64(1 << i % 64)

    def stretches(self, codes: np.ndarray, bounds: np.ndarray):
        """(text, start in it, place of the needle) of the stretches to look into. ``codes``: of all texts, one behind the other at ``bounds``; the last code is of no needle."""
        counts = -(-np.diff(bounds) // self.step)
        text = np.repeat(np.arange(len(counts)), counts)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * self.step
        size, length = max(1, TILE_PAIRS // len(self.numbers)), self.step + self.longest - 1
        for at in range(0, len(text), size):
            t, s = text[at : at + size], start[at : at + size]
            whole = bounds[t + 1] - bounds[t]
            place = s[:, None] + np.arange(length)
            held = np.where(place < whole[:, None], codes[np.minimum(place + bounds[t][:, None], len(codes) - 1)], self.masks.shape[1] - 1).T.copy()
            common = self._common(held)
            cut = s + length > whole
            least = np.ceil(self.threshold * (self.n + np.minimum(self.n, whole[:, None])) / 2 - 1e-9) - self.behind
            rows, found = np.nonzero(common >= np.where(cut[:, None], least, self.inner))
            yield from zip(t[rows].tolist(), s[rows].tolist(), found.tolist())

    def _common(self, held: np.ndarray) -> np.ndarray:
        """Lengths (stretches, needles) of the longest common subsequences with the needles' heads, ``held`` being the codes (places, stretches)."""
        shape = (held.shape[1], len(self.numbers))
        v = [np.full(shape, np.iinfo(np.uint64).max, np.uint64) for _ in range(self.words)]
        u, total = np.empty(shape, np.uint64), np.empty(shape, np.uint64)
        for column in held:
            carry = None
            for k, x in enumerate(v):
                np.take(self.masks[k], column, 0, u, "clip")
                np.bitwise_and(x, u, u)
                np.add(x, u, total)
                if self.words > 1:
                    over = total < u
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                np.subtract(x, u, x)
                np.bitwise_or(x, total, x)
        return 64 * self.words - sum(np.bitwise_count(x).astype(np.int64) for x in v)


def _groups(needles: list[_Needle], threshold: float, strict: bool) -> tuple[list[_Group], np.ndarray]:
    """The needles in groups of about one length, and the code of each code point."""
    alphabet = {c: i for i, c in enumerate(sorted({c for x in needles for c in x.masks}))}
    table = np.full(0x110000, len(alphabet), np.int32)
    table[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    parts: list[list[int]] = []
    for i in sorted(range(len(needles)), key=lambda i: len(needles[i].text)):
        if parts and len(parts[-1]) < GROUP_NEEDLES and len(needles[i].text) * 4 <= len(needles[parts[-1][0]].text) * 5:
            parts[-1].append(i)
        else:
            parts.append([i])
    return [_Group([needles[i] for i in part], part, alphabet, threshold, strict) for part in parts], table


def _taken(hays: list[str]):
    """(first, last + 1) of runs of texts with about TAKEN_CHARACTERS together."""
    first = size = 0
    for i, hay in enumerate(hays):
        size += len(hay)
        if size >= TAKEN_CHARACTERS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(hays):
        yield first, len(hays)


def _near_pairs(hays: list[str], needles: list[_Needle], groups: list[_Group], table: np.ndarray, threshold: float, strict: bool) -> set[tuple[int, int]]:
    """(text, needle) of all texts and needles of which a window's ratio reaches the threshold."""
    pairs: set[tuple[int, int]] = set()
    for first, last in _taken(hays):
        some = hays[first:last]
        codes = table[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in some])))
        for group in groups:
            for i, low, found in group.stretches(codes, bounds):
                pair = first + i, group.numbers[found]
                if pair not in pairs and needles[pair[1]].near(some[i], threshold, strict, low, low + group.step):
                    pairs.add(pair)
    return pairs


def _fuzzy(needle: str | None, hay: str | None, threshold: float, strict: bool) -> bool:
    return needle is not None and hay is not None and _Needle(needle).near(hay, threshold, strict)


def fuzzy_match(needle: Column, hay: Column, threshold: float = FUZZY, strict: bool = False) -> Column:
    """Whether some window of ``hay`` has a matching-blocks ratio of ``threshold``. Windows start every fifth of the needle and are 15 longer than it, or as long with ``strict``. Both are normalised."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_fuzzy(x, y, threshold, strict) for x, y in zip(a, b)])

    return run(normalize_tokens(needle), normalize_tokens(hay))


def fuzzy_join(quotes: DataFrame, docs: DataFrame, threshold: float = FUZZY, strict: bool = False, block: int = BLOCK_QUOTES) -> DataFrame:
    """(doc_id, quote_id) of all quotes (quote_id, quote) that ``fuzzy_match`` texts (doc_id, text), each pair of ids once.

    Quotes are cut in blocks of ``block`` by hash; a block travels with the tasks, and the texts are read once a block where
    they lie. Stretches of text of some windows' length are compared with all quotes of about one length at once, by the
    bits of their longest common subsequences (``_Group``, which loses none); only the windows of those that can reach the
    threshold are matched. Quotes of fewer than four characters, and null ones, match nothing.
    """
    spark = docs.sparkSession
    asked = quotes.select("quote_id", normalize_tokens(F.col("quote")).alias("needle")).where(F.length("needle") >= 4).distinct()
    texts = docs.select("doc_id", normalize_tokens(F.col("text")).alias("hay")).where("hay <> ''")
    kind = quotes.schema["quote_id"].dataType.simpleString()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quote_id {kind}"
    if texts.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # few files: the work is in the matching, not in the bytes
        texts = texts.repartition(spark.sparkContext.defaultParallelism)
    blocks = -(-asked.count() // block)
    parts = [spark.createDataFrame([], schema)]
    for b in range(blocks):
        held = spark.sparkContext.broadcast([(r["quote_id"], r["needle"]) for r in asked.where(F.pmod(F.xxhash64("quote_id", "needle"), F.lit(blocks)) == b).collect()])

        def run(batches, held=held):
            ids, needles = [quote_id for quote_id, _ in held.value], [_Needle(needle) for _, needle in held.value]
            groups, table = _groups(needles, threshold, strict)
            for batch in batches:
                pairs = sorted(_near_pairs(batch.column(1).to_pylist(), needles, groups, table, threshold, strict))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in pairs], pa.int64())), pa.array([ids[q] for _, q in pairs], id_type)], ["doc_id", "quote_id"])

        id_type = asked.select("quote_id").limit(0).toArrow().schema[0].type
        parts.append(texts.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts).distinct()


def literal_match(needle: Column, hay: Column, strict: bool = False) -> Column:
    """Folded or normalised containment. A quote without letters or digits is in every text, unless ``strict``."""
    found = F.contains(fold(hay), fold(needle)) | F.contains(normalize_tokens(hay), normalize_tokens(needle))
    return found & (fold(needle) != "") if strict else found


def anchors(notes: DataFrame) -> DataFrame:
    """(note_id, ord, up_name, quote, ts_start, ts_end) of complete anchors in notes (note_id, value)."""
    groups = F.arrays_zip(*[F.regexp_extract_all("value", F.lit(ANCHOR), i).alias(c) for i, c in enumerate(("up_name", "quote", "ts_start", "ts_end"), 1)])
    rows = notes.select("note_id", F.posexplode(groups).alias("ord", "a"))
    return rows.select("note_id", "ord", strip(F.col("a.up_name")).alias("up_name"), strip(F.col("a.quote")).alias("quote"), "a.ts_start", "a.ts_end")


def parse_cues(archives: DataFrame) -> DataFrame:
    """(archive_id, source_no, cue_no, s, e, text) of archives (archive_id, value) with '[a --> b] text' lines, sections split at '=== SOURCE: '."""
    rows = archives.select("archive_id", F.posexplode(F.split("value", "=== SOURCE: ")).alias("source_no", "part"))
    cues = F.arrays_zip(*[F.regexp_extract_all("part", F.lit(CUE), i).alias(c) for i, c in enumerate(("a", "b", "text"), 1)])
    rows = rows.select("archive_id", "source_no", F.posexplode(cues).alias("cue_no", "c"))
    return rows.select("archive_id", "source_no", "cue_no", ts_to_sec(F.col("c.a")).cast("double").alias("s"), ts_to_sec(F.col("c.b")).cast("double").alias("e"), F.col("c.text").alias("text")).where("s is not null and e is not null")


def provenance(notes: DataFrame, archives: DataFrame) -> DataFrame:
    """(note_id, has_archive, unsupported): of notes with anchors, whether there is an archive text, and which anchors (by number) it doesn't hold literally, nearly, or by recall near their times."""
    s, e = ts_to_sec(F.col("ts_start")), ts_to_sec(F.col("ts_end"))
    rows = anchors(notes).withColumns({"s": s, "e": e, "window_id": F.col("ord")})
    plain = archives.select(F.col("archive_id").alias("note_id"), F.regexp_replace("value", r"\[(?U:\s*)\d{1,2}:\d{2}(?::\d{2})?(?:(?U:\s*)-->(?U:\s*)\d{1,2}:\d{2}(?::\d{2})?)?(?U:\s*)\]", "").alias("plain"))
    rows = rows.join(plain, "note_id", "left").withColumn("literal", literal_match(F.col("quote"), F.col("plain")))
    open_ = rows.where("not literal and s is not null and e is not null").select(F.col("note_id").alias("archive_id"), "window_id", F.col("s").cast("double").alias("s0"), F.col("e").cast("double").alias("e0"), "quote")
    near = recall(parse_cues(archives), open_).select(F.col("archive_id").alias("note_id"), "window_id", (F.col("n_hit") / F.col("n_quote") >= RECALL).alias("near"))
    fuzzy = rows.where("not literal").select("note_id", "window_id", fuzzy_match(F.col("quote"), F.col("plain")).alias("fuzzy"))
    rows = rows.join(near, ["note_id", "window_id"], "left").join(fuzzy, ["note_id", "window_id"], "left")
    ok = F.coalesce("literal", F.lit(False)) | F.coalesce("near", F.lit(False)) | F.coalesce("fuzzy", F.lit(False))
    return rows.groupBy("note_id").agg(F.bool_or(F.coalesce(F.col("plain") != "", F.lit(False))).alias("has_archive"), F.collect_list(F.when(~ok, F.col("ord"))).alias("unsupported"))


def with_anchor_codes(notes: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """``notes`` (note_id, value, …) with anchor_count, anchor_errors and anchor_warnings, codes sorted. Without ``archives`` all is read in the row, and nothing is joined."""
    found = F.transform(F.arrays_zip(*[F.regexp_extract_all("value", F.lit(ANCHOR), i).alias(c) for i, c in enumerate(("up_name", "quote", "ts_start", "ts_end"), 1)]), lambda a: F.struct(strip(a["up_name"]).alias("up_name"), strip(a["quote"]).alias("quote"), ts_to_sec(a["ts_start"]).alias("s"), ts_to_sec(a["ts_end"]).alias("e")))
    rows = notes.withColumns({"__found": found, "__markers": F.regexp_count("value", F.lit(MARKER)), "__mentions": F.regexp_count("value", F.lit(MENTION))})
    if archives is None:
        has, lost = F.lit(False), F.array().cast("array<int>")
    else:
        support = provenance(notes.select("note_id", "value"), archives).select(F.col("note_id").alias("__of"), "has_archive", "unsupported")
        rows = rows.join(support, F.col("note_id") == F.col("__of"), "left")
        has, lost = F.coalesce("has_archive", F.lit(False)), F.coalesce("unsupported", F.array().cast("array<int>"))
    quotes = F.transform("__found", lambda a: a["quote"])

    def errors(a, i):
        some = a["quote"] != ""
        return F.array_compact(F.array(
            F.when(~some, "empty_quote"),
            F.when(some & (F.length(a["quote"]) > MAX_QUOTE), "long_quote"),
            F.when(some & (a["up_name"] == ""), "no_name"),
            F.when(some & (F.array_position(quotes, a["quote"]) <= i), "duplicate"),
            F.when(some & (a["s"].isNull() | a["e"].isNull()), "bad_time").when(some & (a["s"] > a["e"]), "reversed_time"),
            F.when(some & has & F.array_contains(lost, i), "unsupported"),
        ))

    def warnings(a):
        some = a["quote"] != ""
        return F.array_compact(F.array(F.when(some & (F.contains(a["quote"], F.lit("…")) | F.contains(a["quote"], F.lit("..."))), "ellipsis"), F.when(some & ~has, "no_archive")))

    n = F.size("__found")
    base = F.array_compact(F.array(F.when(n > MAX_ANCHORS, "too_many"), F.when(F.col("__markers") != n, "incomplete"), F.when(F.col("__mentions") > F.col("__markers"), "format_drift")))
    codes = {"anchor_count": n.cast("long"), "anchor_errors": F.array_sort(F.concat(base, F.flatten(F.transform("__found", errors)))), "anchor_warnings": F.array_sort(F.flatten(F.transform("__found", warnings)))}
    return rows.select(*[F.col(c) for c in notes.columns], *[c.alias(name) for name, c in codes.items()])


def check_anchors(notes: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """(note_id, anchor_count, errors, warnings), codes sorted, of notes (note_id, value); archives (archive_id = note_id, value) enable provenance.

    A note without a row in ``archives`` counts as without an archive.
    """
    rows = with_anchor_codes(notes.select("note_id", "value"), archives)
    return rows.select("note_id", "anchor_count", F.col("anchor_errors").alias("errors"), F.col("anchor_warnings").alias("warnings"))
