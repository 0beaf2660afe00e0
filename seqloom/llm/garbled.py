"""Text that was decoded with the wrong encoding: find it, and restore it where possible.

1. Corpus statistics: in how many documents each pair of adjacent characters occurs, and each character, for all pairs with
   a character beyond ASCII.  Characters of the large scripts are taken by blocks, so that the table has a fixed bound.
2. Improbable runs: every pair is scored by the mutual information of its characters, and the maximum-scoring segments of
   what is missing to a probable pair are taken.  A run is a stretch around characters beyond ASCII in such a segment.
   It is judged once for the whole corpus, however many documents hold it.
3. Inverse mappings, only of these runs: a run is written back to bytes with each encoding that may have been the wrong one,
   and the bytes are read as UTF-8 or as another encoding.  The mapping is tested by the attestation of the pairs of the
   result against those of the run as it stands, in bits per pair; garbled text can be garbled again, so this repeats.
4. A document is garbled if one of its runs is; replacement characters mark it too, as what stood there is lost.

Mutual information finds what is improbable, and text beyond ASCII that nobody garbled is mostly so as well; whether a run is
garbled, the test of the mapping decides.  A run that is garbled in part fails as a whole; then the stretches of it that
an encoding can write and that are UTF-8 are restored one by one, the one with the greatest score first.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import Workspace

REPLACEMENT = "�"
#: Encodings that text may have been read in by mistake, and those it may have been written in.
WRONG_SINGLE = ("cp1252", "cp1251", "cp1250", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "iso8859_2", "iso8859_5", "cp1253", "cp1254", "cp1257", "iso8859_15")
WRONG_MULTI = ("gb18030", "shift_jis", "big5", "euc_kr", "euc_jp")
RIGHT_SINGLE = ("cp1252", "cp1251", "cp1250", "cp1253", "cp1254", "cp1257", "cp1258", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15")
RIGHT_MULTI = ("gb18030", "shift_jis", "euc_jp", "euc_kr", "big5")

#: The core of a run: characters beyond ASCII with the letters and digits between them.
_CORE = re.compile(r"[^\x00-\x7f]+(?:[0-9A-Za-z_]*[^\x00-\x7f]+)*")
#: Bytes of a stretch of UTF-8: characters beyond ASCII with the letters and digits between them.
_WIDE = rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})"
_STRETCH = re.compile(_WIDE + rb"(?:[0-9A-Za-z_]*" + _WIDE + rb")*")
_ASCII = "".join(map(chr, range(128)))
_ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _tables() -> tuple[dict[str, dict[int, int]], dict[str, str]]:
    """Per single-byte encoding: code point -> byte, and the 256 characters. Undefined bytes are control characters,
    as browsers read them, and a control character stands for its byte in every encoding."""
    to_byte, to_char = {}, {}
    for name in {*WRONG_SINGLE, *RIGHT_SINGLE}:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        to_char[name] = "".join(chars)
        to_byte[name] = {**{b: b for b in range(128, 160)}, **{ord(c): b for b, c in enumerate(chars)}}
    return to_byte, to_char


_TO_BYTE, _TO_CHAR = _tables()


#: Number of classes at most; the number after the last one stands for "any".
N_CLASSES = 4095
_ANY = N_CLASSES


def classes(codes: np.ndarray) -> np.ndarray:
    """Class of a code point: itself in the alphabets, the punctuation and the symbols, its block of 512 or 256 elsewhere, its
    plane beyond the first."""
    c = np.asarray(codes, np.int64)
    low, high = 0x0600 + (c - 0x0600 >> 9), 0x060C + (c - 0x1E00)
    return np.where(c < 0x0600, c, np.where(c < 0x1E00, low, np.where(c < 0x2700, high, np.where(c < 0x10000, 0x0F0C + (c - 0x2700 >> 8), 0x0FE5 + (c >> 16)))))


def class_of(c: int) -> int:
    """The same of one code point."""
    if c < 0x0600:
        return c if c >= 32 else 32
    if c < 0x1E00:
        return 0x0600 + (c - 0x0600 >> 9)
    if c < 0x2700:
        return 0x060C + c - 0x1E00
    return 0x0F0C + (c - 0x2700 >> 8) if c < 0x10000 else 0x0FE5 + (c >> 16)


def text_classes(text: str) -> np.ndarray:
    """Classes of the characters of a text, which begins and ends with a space; control characters count as spaces."""
    c = classes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    return np.concatenate(([32], np.where(c < 32, 32, c), [32]))


def pair_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, documents it occurs in, occurrences) over a batch of texts, for pairs with a class beyond ASCII; pair = a << 12 | b.
    A pair of a class and _ANY has the occurrences of the class, that of _ANY twice all documents."""
    found, counts, ascii_ = [], [], np.zeros(128, np.int64)
    for t in texts:
        if t.isascii():
            ascii_ += np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=128)
            continue
        c = text_classes(t)
        at = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127))
        for codes in (c[at] << 12 | c[at + 1], c << 12 | _ANY):
            pairs, n = np.unique(codes, return_counts=True)
            found.append(pairs)
            counts.append(n)
    ascii_[32] += ascii_[:32].sum()
    pairs, at = np.unique(np.concatenate([*found, np.arange(32, 128) << 12 | _ANY, [_ANY << 12 | _ANY]]), return_inverse=True)
    occ = np.concatenate([*counts, ascii_[32:], [0]])
    docs = np.concatenate([*(np.ones(len(x), np.int64) for x in found), np.zeros(96, np.int64), [len(texts)]])
    return pairs, np.bincount(at, docs).astype(np.int64), np.bincount(at, occ).astype(np.int64)


_QUOTES = "\"'`"
#: Words of a line that names characters on purpose, and calls that repair them: what these name is left alone.
_NAMING = re.compile(r"(?i)decod|encod|sample|invalid|garbl|fffd|(?<![a-z])bad|\b(?:count|find|index|indexOf|contains|includes|split|strip|reject)\s*\(")
_REPAIR = re.compile(r"(?i)mojibake|(?:replace|replaceAll|gsub|sub|translate|maketrans)\s*\(")
_WORD = re.compile(r"\w{1,24}\W{0,24}$")


def _spaced(text: str) -> str:
    return "".join(c if c > " " else " " for c in text)


def _literal(text: str, i: int, j: int) -> str | None:
    """Key of the quoted literal text[i:j]: the last word of its line before it, the run, three characters after it, both without
    characters beyond ASCII, and whether the line names characters on purpose. None in a call that repairs text."""
    left, right = text[max(text.rfind("\n", 0, i) + 1, i - 200) : i], text[j : j + 100].split("\n")[0]
    if _REPAIR.search(left + right):
        return None
    plain = lambda t: "".join(c for c in t if c < "\x7f")
    word = _WORD.search(plain(left))
    named = "named" if _NAMING.search(left + right) else ""
    return f"{_spaced(word.group() if word else left[-1])}\t{text[i:j]}\t{_spaced(plain(right)[:3])}\t{named}"


def runs(text: str, literals: bool = False):
    """(start, end, key) of the runs of a text; key is (before, run, after) joined by tabs.

    A run is a core with all letters and digits that adjoin it. The neighbours are one character on either side, or four and
    three around a single symbol that no letter or digit adjoins, as such a symbol can only be judged by its surroundings.
    White space and the ends of the text count as spaces. A run of at most four characters that is all of a quoted literal may
    be named on purpose: it is given only with ``literals``, and its key has a fourth field, see _literal.
    """
    end = 0
    for m in _CORE.finditer(text):
        i, j = m.span()
        if i and j < len(text) and j - i <= 4 and text[i - 1] == text[j] and text[j] in _QUOTES:
            if literals and (key := _literal(text, i, j)) is not None:
                end = j
                yield i, j, key
            continue
        while i > end and text[i - 1] in _ALNUM:
            i -= 1
        while j < len(text) and text[j] in _ALNUM:
            j += 1
        end = j
        wide = j - i == 1
        before, after = text[max(0, i - (4 if wide else 1)) : i], text[j : j + (3 if wide else 1)]
        yield i, j, f"{_spaced(before) or ' '}\t{text[i:j]}\t{_spaced(after) or ' '}"


def maximal_segments(scores: list[float]) -> list[tuple[int, int]]:
    """(start, end) of all maximum-scoring segments of a sequence of scores, in linear time: the segment of the greatest sum, and
    in the same way those of what lies before and after it, down to the last positive score."""
    total, found = 0.0, []  # found: start, end, sum before, sum up to the end
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, low = i, before
        # join backwards while the segment found last does not hold its own: it begins lower and does not reach as high
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= low:
                k = found[k][4]
            if k < 0 or found[k][3] >= total:
                found.append((start, i + 1, low, total, k))
                break
            start, low = found[k][0], found[k][2]
            del found[k:]
    return [f[:2] for f in found]


class Pairs:
    """Documents and pointwise mutual information per pair, as sorted arrays: twelve bytes a pair, and never more than N_CLASSES^2
    pairs, 201 MB. Pairs of one document are left out."""

    #: Documents that a pair must be in for its information to count.
    EVIDENCE = 100
    #: Information of a pair that nothing is known of.
    LEAST = -12.0

    def __init__(self, pairs: np.ndarray, n: np.ndarray, occ: np.ndarray):
        whole = pairs & 4095 == _ANY
        of_class = np.zeros(4096)
        of_class[pairs[whole] >> 12] = occ[whole]
        self.n_docs = int(n[whole & (pairs >> 12 == _ANY)].sum())
        keep = np.flatnonzero(~whole & (n >= 2))
        keep = keep[np.argsort(pairs[keep])]
        self.pairs, self.n = pairs[keep].astype(np.int32), np.minimum(n[keep], 2**31 - 1).astype(np.int32)
        expected = of_class[self.pairs >> 12] * of_class[self.pairs & 4095] / max(of_class.sum(), 1.0)
        self.pointwise = np.log2(np.maximum(occ[keep], 1) / np.maximum(expected, 1e-9)).astype(np.float32)

    def __len__(self) -> int:
        return len(self.pairs)

    def __getitem__(self, pair: int) -> int:
        i = int(self.pairs.searchsorted(np.int32(pair)))
        return int(self.n[i]) if i < len(self.pairs) and self.pairs[i] == pair else 0

    def information(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log2 of the part, in bits a document, that pairs (a, b) have in the mutual information of neighbours: the share of the
        documents with the pair times its pointwise information. Least where too few documents have the pair to tell, and for
        pairs with a block, as these say nothing on the character."""
        if not len(self.pairs):
            return np.full(len(a), self.LEAST)
        pair = (a << 12 | b).astype(np.int32)
        i = np.minimum(self.pairs.searchsorted(pair), len(self.pairs) - 1)
        block = lambda x: (x >= 0x0600) & (x < 0x060C) | (x >= 0x0F0C)
        known = (self.pairs[i] == pair) & (self.n[i] >= self.EVIDENCE) & ~block(a) & ~block(b)
        bits = np.log2(self.n[i] / self.n_docs) + np.log2(np.maximum(self.pointwise[i], 1e-3))
        return np.where(known, np.maximum(bits, self.LEAST), self.LEAST)


def segments(text: str, table: Pairs, probable: float = -3.5, plain: float = 4.0) -> list[tuple[int, int]]:
    """Segments (start, end) of a text whose pairs are improbable: maximum-scoring segments of ``probable`` (an eleventh of a bit
    a document) less the information of each pair. A pair of two ASCII characters stays as it is under every mapping, so it costs ``plain`` bits and no more."""
    c = text_classes(text)
    at = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127))
    if not len(at):
        return []
    missing = probable - table.information(c[at], c[at + 1])
    gaps = np.diff(at) - 1
    # pairs and the gaps between them in turn; gap k follows pair k
    scores = np.zeros(2 * len(at) - 1)
    scores[::2], scores[1::2] = missing, -plain * gaps
    # pair q is that of the characters q - 1 and q
    return [(int(at[i // 2]), int(at[(j - 1) // 2]) + 1) for i, j in maximal_segments(scores.tolist())]


def improbable_runs(text: str, table: Pairs) -> dict[str, bool]:
    """Keys of the runs of a text, and whether one of the runs lies in an improbable segment, at least in part."""
    out: dict[str, bool] = {}
    found, k = segments(text, table), 0
    for i, j, key in runs(text, literals=True):
        while k < len(found) and found[k][1] <= i:
            k += 1
        out[key] = out.get(key, False) or k < len(found) and found[k][0] <= j
    return out


class _Association(dict):
    """Association of pairs in bits, looked up when first asked for; the answers kept are at most ``most``."""

    def __init__(self, table: Pairs, most: int = 500_000):
        super().__init__()
        self.table, self.most = table, most

    def __missing__(self, pair: int) -> float:
        if len(self) >= self.most:
            self.clear()
        x = self[pair] = math.log2(1 + self.table[pair])
        return x


class Judge:
    """Decides on runs with the corpus statistics: ``table`` has the number of documents of a pair."""

    def __init__(self, table: Pairs, least_gain: float = 1.0, least_documents: int = 2):
        self.log = _Association(table)
        self.least_gain, self.least_documents = least_gain, math.log2(1 + least_documents)

    def score(self, text: str) -> tuple[float, float]:
        """Mean and least association, in bits, of the pairs with a character beyond ASCII; (nothing, nothing) without."""
        total, n, least = 0.0, 0, 99.0
        last = None
        log = self.log
        for ch in text:
            c = class_of(ord(ch))
            if last is not None and (c > 127 or last > 127):
                x = log[last << 12 | c]
                total, n = total + x, n + 1
                if x < least:
                    least = x
            last = c
        return (total / n, least) if n else (0.0, 0.0)

    @staticmethod
    def _bytes(text: str) -> list[tuple[str, bytes]]:
        out, seen = [], set()
        for name in WRONG_SINGLE:
            table = _TO_BYTE[name]
            try:
                raw = bytes([table[ord(c)] for c in text])
            except KeyError:
                continue
            if raw not in seen:
                seen.add(raw)
                out.append((name, raw))
        if any(ord(c) >= 0x2E80 for c in text):
            for name in WRONG_MULTI:
                try:
                    raw = text.encode(name)
                except UnicodeEncodeError:
                    continue
                if raw not in seen:
                    seen.add(raw)
                    out.append((name, raw))
        return out

    @staticmethod
    def _utf8(raw: bytes) -> str | None:
        """UTF-8 of all bytes, but for an incomplete character at either end (a cut), which is left out."""
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
        head = re.match(rb"[\x80-\xbf]{0,3}", raw).end()
        tail = re.search(rb"(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2})?$", raw).start()
        if tail - head < 4:
            return None
        try:
            return raw[head:tail].decode("utf-8")
        except UnicodeDecodeError:
            return None

    def restored(self, key: str) -> tuple[str, str, float] | None:
        """(restored run, mapping, gain in bits a pair) of a run; None if no mapping makes it better attested. Only the core
        is mapped, with one letter or digit on either side: the one after it may be the second byte of a character, all others
        are the same in every encoding."""
        before, run, after = key.split("\t")[:3]
        core = run.strip(_ASCII)
        at = len(run) - len(run.lstrip(_ASCII))
        i, j = max(0, at - 1), min(len(run), at + len(core) + 1)
        head, tail = run[:i], run[j:]
        found = self._restored((head or before)[-1], run[i:j], (tail or after)[0])
        return found and (head + found[0] + tail, *found[1:])

    def _restored(self, before: str, run: str, after: str) -> tuple[str, str, float] | None:
        now, _ = self.score(before + run + after)
        best = None
        for wrong, raw in self._bytes(run):
            options = [("utf_8", self._utf8(raw))]
            options += [(name, raw.decode("latin-1").translate(_TO_CHAR[name])) for name in RIGHT_SINGLE]
            for name in RIGHT_MULTI:
                try:
                    options.append((name, raw.decode(name)))
                except UnicodeDecodeError:
                    pass
            for name, text in options:
                if not text or text == run or text.isascii() or REPLACEMENT in text and name != "utf_8":
                    continue
                mean, least = self.score(before + text + after)
                gain = mean - now
                if name == "utf_8":
                    gain += 1.0  # bytes that are UTF-8 throughout are rarely so by chance
                    deeper = self._further(text)
                    if deeper is not None:
                        text, gain = deeper, max(gain, self.score(before + deeper + after)[0] - now + 2.0)
                elif least < self.least_documents:
                    continue
                if gain >= self.least_gain and (best is None or gain > best[2]):
                    best = (text, f"{wrong}>{name}", gain)
        if best is None or not best[1].endswith(">utf_8"):
            part = self._in_part(before, run, after)
            if part is not None and (best is None or part[2] > best[2]):
                return part
        return best

    @staticmethod
    def _stretches(text: str):
        """(encoding, start, end, restored) of the maximal stretches that an encoding can write and that are UTF-8 then."""
        for name in WRONG_SINGLE:
            table = _TO_BYTE[name]
            raw = bytes([table.get(ord(c), 255) for c in text])  # 255 is no byte of UTF-8
            for m in _STRETCH.finditer(raw):
                try:
                    yield name, m.start(), m.end(), m.group().decode("utf-8")
                except UnicodeDecodeError:
                    pass
        if any(ord(c) >= 0x2E80 for c in text):
            for name in WRONG_MULTI:
                raw, at = b"", {0: 0}
                for i, c in enumerate(text):
                    raw += c.encode(name, "ignore") or b"\xff"
                    at[len(raw)] = i + 1
                for m in _STRETCH.finditer(raw):
                    if m.start() in at and m.end() in at:
                        try:
                            restored = m.group().decode("utf-8")
                        except UnicodeDecodeError:
                            continue
                        if all(ord(c) < 0x2E80 for c in restored):  # the blocks of the large scripts prove nothing here
                            yield name, at[m.start()], at[m.end()], restored

    def _in_part(self, before: str, run: str, after: str) -> tuple[str, str, float] | None:
        """(run, mapping, gain) with the stretches restored that are better attested so, every pair of them; None if none is.
        The least gain of a stretch is that of the run."""
        text, first, least_gain, seen = run, None, 99.0, {run}
        while True:
            best = None
            whole = before + text + after
            for wrong, i, j, restored in self._stretches(text):
                left, right = whole[i], whole[j + 1]
                mean, least = self.score(left + restored + right)
                gain = mean - self.score(left + text[i:j] + right)[0]
                if gain >= self.least_gain and least >= self.least_documents and (best is None or gain * len(restored) > best[0]):
                    best = (gain * len(restored), text[:i] + restored + text[j:], f"{wrong}>utf_8", gain)
            if best is None or best[1] in seen:
                return (text, first, least_gain) if first else None
            text, first, least_gain = best[1], first or best[2], min(least_gain, best[3])
            seen.add(text)

    def forms(self, run: str) -> dict[str, str]:
        """Every text -> mapping that a short run may have been before one wrong reading, likely or not."""
        out: dict[str, str] = {}
        for wrong, raw in [*self._bytes(run), ("utf_8", run.encode("utf-8", "surrogatepass"))]:
            for right in ("utf_8", *RIGHT_SINGLE, *RIGHT_MULTI):
                try:
                    text = raw.decode("latin-1").translate(_TO_CHAR[right]) if right in _TO_CHAR else raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if text != run and not text.isascii() and "\t" not in text:
                    out.setdefault(text, f"{wrong}>{right}")
        return out

    def _further(self, text: str) -> str | None:
        """The text after all further rounds of UTF-8 that was read wrongly, as far as they can be undone."""
        out, seen = None, {text}
        while True:
            for _, raw in self._bytes(text):
                earlier = self._utf8(raw)
                if earlier and earlier not in seen and not earlier.isascii():
                    out = text = earlier
                    seen.add(text)
                    break
            else:
                return out


def _count_pairs(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair_counts([t for t in b.column(0).to_pylist() if t])], ["pair", "n", "occ"])


def pair_table(docs: DataFrame, text: str) -> Pairs:
    """Documents and information per pair, over all documents. Pairs of one document say nothing and are left out; no other
    pair is. The classes bound the table, not the number of documents, so it is brought to the driver whatever that is."""
    counts = docs.select(text).mapInArrow(_count_pairs, "pair long, n long, occ long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("occ").alias("occ"))
    counts = Workspace(docs.sparkSession, "pairs").write(counts, "counts")
    t = counts.where(f"n >= 2 or pair & 4095 = {_ANY}").toArrow()
    return Pairs(*(t[c].to_numpy() for c in ("pair", "n", "occ")))


def _list_runs(table):
    def run(batches):
        pairs = table.value
        for b in batches:
            at, keys, inside = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t or t.isascii():
                    continue
                of = improbable_runs(t, pairs)
                at += [i] * len(of)
                keys += of
                inside += of.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string()), pa.array(inside, pa.bool_())], ["doc", "run", "improbable"])

    return run


def _forms_of(judge: Judge, key: str):
    """(original, mapping, gain, key of the original, whether only its attestation counts) of the forms a run may be restored to."""
    before, text, after, *literal = key.split("\t")
    expected = lambda t: "\t".join([before, t, after, *literal])
    if REPLACEMENT in text:
        if literal != ["named"]:
            yield None, "lost", 0.0, None, False
        elif text != REPLACEMENT:
            yield None, "lost", 0.0, expected(REPLACEMENT), True
        return
    if literal != ["named"] and (found := judge.restored(key)) is not None:
        yield *found, expected(found[0]), False
    # a literal is also garbled if other code has another form of it at the same place more often
    if literal and any(c.isalnum() for c in before):
        for form, mapping in judge.forms(text).items():
            yield form, mapping, 0.0, expected(form), True


def _judge_runs(table):
    def run(batches):
        judge = Judge(table.value)
        for b in batches:
            out = []
            for key, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += ((key, n, *x) for x in _forms_of(judge, key))
            cols = list(zip(*out)) if out else [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["run", "n_docs", "original", "mapping", "gain", "expected", "literal"])

    return run


def garbled_runs(docs: DataFrame, doc: str, text: str, sure: float = 3.5, runs_per_task: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(improbable runs of documents: doc, run; garbled runs: run, original, mapping, gain, n_docs), both written tables.

    A run that is restored through UTF-8 needs a gain of a bit a pair (a bit is given for being UTF-8). Restored
    through another encoding it must be attested as a run in more documents than the garbled form, or gain ``sure``
    bits a pair; a single symbol must be attested, with its surroundings, in eight times as many documents. A short quoted
    literal on a line that names characters is garbled only if another form of it stands there in more documents.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "garbled")
    docs = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    table = spark.sparkContext.broadcast(pair_table(docs, "text"))
    listed = ws.write(docs.mapInArrow(_list_runs(table), "doc long, run string, improbable boolean"), "runs")
    # probable runs are not judged, but what others may have been is attested by them as well
    counts = ws.write(listed.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.bool_or("improbable").alias("improbable")), "counts")
    # runs are few bytes and much work, so they are divided by their number
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), counts.count() // runs_per_task)
    judged = counts.where("improbable").select("run", "n").repartition(tasks, "run").mapInArrow(_judge_runs(table), "run string, n_docs long, original string, mapping string, gain double, expected string, literal boolean")
    judged = ws.write(judged, "judged")
    attested = judged.join(counts.select(F.col("run").alias("expected"), F.col("n").alias("n_expected")), "expected", "left")
    n = F.coalesce("n_expected", F.lit(0))
    core = F.split("run", "\t")[1]
    # a sentence of the large scripts is rarely written twice; its pairs alone decide
    large = F.col("original").rlike("[\u2e80-\uffef]")
    ok = F.when(F.col("literal"), n >= F.when(F.length(core) == 1, 8 * F.col("n_docs")).otherwise(F.col("n_docs") + 1)).otherwise(
        (F.col("mapping") == "lost")
        | F.when(F.length(core) == 1, n >= 8 * F.col("n_docs"))
        .when(F.col("mapping").endswith(">utf_8"), F.lit(True))
        .otherwise((n > F.col("n_docs")) | (F.col("gain") >= sure) | large)
    )
    best = F.max_by(F.struct("original", "mapping", "gain", "n_docs"), F.struct("literal", n, "gain", "original"))
    return listed.where("improbable").drop("improbable"), ws.write(attested.where(ok).groupBy("run").agg(best.alias("x")).select("run", "x.*"), "garbled")


def _with_garbled(listed: DataFrame, garbled: DataFrame, hot_share: float = 0.001) -> DataFrame:
    """Runs of documents that are garbled. Runs of very many documents, at most 1 / hot_share, are matched by broadcast."""
    total = listed.count()
    limit = max(2, int(hot_share * total))
    hot = F.broadcast(garbled.where(F.col("n_docs") >= limit))
    cold = garbled.where(F.col("n_docs") < limit)
    return listed.join(hot, "run").unionByName(listed.join(cold, "run"))


def garbled_documents(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc) of documents with garbled characters. Null, empty and ASCII texts are none; every id is reported once."""
    return _with_garbled(*garbled_runs(docs, doc, text)).select(F.col("doc").alias(doc)).distinct()


def restore(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text, n_restored, n_lost): the text of each garbled document with its garbled runs replaced.

    ``n_lost`` counts the distinct runs with replacement characters, which stay. Rows with the same id and text
    are one document.
    """
    per = _with_garbled(*garbled_runs(docs, doc, text)).groupBy("doc").agg(
        F.map_from_entries(F.collect_set(F.when(F.col("original").isNotNull(), F.struct("run", "original")))).alias("fixes"),
        F.count_if(F.col("mapping") == "lost").alias("n_lost"),
    )  # one entry for each garbled run of a document, so no larger than its text
    # as a written table its size is known: while it is small, Spark broadcasts it and no text is shuffled but that of garbled documents
    per = Workspace(docs.sparkSession, "fixes").write(per, "fixes")
    texts = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    joined = texts.join(per, "doc").dropDuplicates(["doc", "text"])

    def run(batches):
        for b in batches:
            out, n = [], []
            for t, fixes in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                fixes, parts, last = dict(fixes), [], 0
                for i, j, key in runs(t, literals=True):
                    if key in fixes:
                        parts += [t[last:i], fixes[key]]
                        last = j
                out.append("".join([*parts, t[last:]]))
                n.append(len(fixes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64()), b.column(3)], ["doc", "text", "n_restored", "n_lost"])

    fixed = joined.select("doc", "text", "fixes", "n_lost").mapInArrow(run, "doc long, text string, n_restored long, n_lost long")
    return fixed.withColumnRenamed("doc", doc)
