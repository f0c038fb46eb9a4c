"""Exact merge-type subword encoding by backtracking, and decoding.

A vocabulary of scored pieces defines the encoding: starting from single characters, the adjacent
pair whose concatenation has the best score is merged (leftmost first) until nothing merges. The
same result is found here without running the merges over the text:

* an Aho-Corasick automaton over the pieces gives, for each position, the longest piece starting there;
* a piece may follow another only if re-merging the two strings gives just these two (answers are kept);
* the search takes the longest piece first, shortens it while the pair is incompatible, and steps back
  when nothing fits, marking the position in a bitfield of failed positions so that no position is
  tried twice.

Texts are cut only where no piece can span, so the cut parts encode independently; codes of parts are
kept in a cache of bounded size. Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import whole

SPACE = "▁"
#: Entries of either half of a worker's cache; when the young half is full, it replaces the old one.
CACHE_ENTRIES = 250_000


class Vocabulary:
    """Pieces, their scores and ids, taken from a model file with the library's reader."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.id = {p: i for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.normalize = sp.normalize
        # plain: the model's normalisation is a leading mark and marks for spaces, nothing else
        probe = "a  b\n\téﬁ  "
        self.plain = sp.normalize(probe) == SPACE + probe.replace(" ", SPACE) and sp.normalize("") == ""


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, model_file: str):
        v = self.v = Vocabulary(model_file)
        self._pairs: dict[tuple[str, str], bool] = {}
        reachable = [p for p in v.id if self._merge(p) == [p]]
        self._known = set(reachable)
        self._automaton = ahocorasick.Automaton()
        for p in reachable:
            self._automaton.add_word(p, len(p))
        self._automaton.make_automaton()
        # shorter[p]: the next shorter piece that p starts with
        self._shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self._known), "") for p in reachable}
        spans = any(SPACE in p.lstrip(SPACE) for p in v.id)
        used = {c for p in v.id for c in p}
        self._lone = "" if any("\n" in p for p in v.id) else "\n"
        self._cuts = None if spans else re.compile(f"{SPACE}*[^{SPACE}{self._lone}]+|{SPACE}+|\n" if self._lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._used = used
        self._young: dict[str, tuple[str, str]] = {}
        self._old: dict[str, tuple[str, str]] = {}

    # -- the merge rule, used for pairs and for checking pieces ------------------------------------

    def _merge(self, s: str) -> list[str]:
        """Merges by best score, leftmost first, with a queue; s is short (a piece or two)."""
        score = self.v.score
        parts: list[str] = list(s)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        queue: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j != -1 and (rank := score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-rank, i, both, j))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, both, j = heapq.heappop(queue)
            if not parts[i] or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] != -1:
                before[after[j]] = i
            if before[i] != -1:
                offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def _fits(self, a: str, b: str) -> bool:
        got = self._pairs.get((a, b))
        if got is None:
            got = self._merge(a + b) == [a, b]
            if len(self._pairs) > CACHE_ENTRIES:
                self._pairs.clear()
            self._pairs[a, b] = got
        return got

    # -- encoding -----------------------------------------------------------------------------------

    def _search(self, s: str) -> list[str]:
        """Pieces of one independent part of a normalised text."""
        n = len(s)
        longest = [1] * n
        for end, k in self._automaton.iter(s):
            if k > longest[end - k + 1]:
                longest[end - k + 1] = k
        open_ = bytearray(b"\x01") * (n + 1)  # the bitfield: 0 where the search has failed
        out: list[str] = []
        pos, piece = 0, s[: longest[0]]
        fits, shorter = self._fits, self._shorter
        while pos < n:
            last = out[-1] if out else ""
            while piece:
                end = pos + len(piece)
                if open_[end] and (not last or fits(last, piece)):
                    break
                piece = shorter.get(piece, "")
            if piece:
                out.append(piece)
                pos = end
                if pos < n:
                    piece = s[pos : pos + longest[pos]]
            else:
                if not out:  # no compatible cover: cannot happen for a vocabulary closed under merging
                    return self._merge(s)
                open_[pos] = 0
                piece = out.pop()
                pos -= len(piece)
        return out

    def _ids(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        for p in pieces:
            i = self.v.id.get(p)
            if i is not None:
                ids.append(i)
            elif self.v.bytes:
                ids += [self.v.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.v.unknown)
        return ids

    def _coded(self, part: str) -> tuple[str, str]:
        """Ids (decimal, comma-joined) and decoded text of a part that the young half of the cache lacks."""
        got = self._old.get(part)
        if got is None:
            ids = self._ids(self._search(part))
            got = (",".join(map(str, ids)), self._pieces_text(ids))
        if len(part) <= 64:
            if len(self._young) >= CACHE_ENTRIES:
                self._old, self._young = self._young, {}
            self._young[part] = got
        return got

    def _parts(self, text: str) -> list[str]:
        normal = SPACE + text.replace(" ", SPACE) if self.v.plain and text else self.v.normalize(text) if text else ""
        return self._cuts.findall(normal) if self._cuts else [normal] if normal else []

    def coded(self, text: str) -> tuple[str, str]:
        """Comma-joined ids of a text, and the decoding of these ids."""
        get, make = self._young.get, self._coded
        both = []
        for p in self._parts(text):
            got = get(p)
            if got is None:
                got = make(p)
                get = self._young.get
            both.append(got)
        decoded = "".join([b for _, b in both])
        return ",".join([a for a, _ in both]), decoded[1:] if decoded[:1] == " " else decoded

    def encode(self, text: str) -> list[int]:
        ids, _ = self.coded(text)
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, runs of byte pieces are read as UTF-8 (a bad byte gives U+FFFD); a mark that leads the first piece goes."""
        text = self._pieces_text(ids)
        first = next((i for i in ids if i not in self.v.silent), None)
        return text[1:] if first is not None and first not in self.v.byte_of and self.v.pieces[first][:1] == SPACE else text

    def _pieces_text(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (b := self.v.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i == self.v.unknown:
                out.append(" ⁇ ")
            elif i not in self.v.silent:
                out.append(self.v.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(run))
        return "".join(out)


def _utf8(run: bytearray) -> str:
    """Valid sequences decode; every byte that starts none becomes one U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for k in (1, 2, 3, 4):
            try:
                out.append(run[i : i + k].decode("utf-8"))
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """One codec for each model and process; its caches outlive a task."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def encode_documents(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encodes and decodes every whole text; one row for each input row.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256 (both lowercase hex; ids in decimal, joined
    by commas), then ``ids array<int>`` if with_ids and ``decoded`` if with_text. Null and empty texts
    have no ids: n_tokens 0 and the digests of the empty string. Repeated rows give repeated rows; a null
    id stays null; other columns of the input are not read. No shuffle: each task codes what it scans.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text"))
    kind = f"doc_id {id_type.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        sha = hashlib.sha256
        for batch in batches:
            n, ids_hex, text_hex, all_ids, texts = [], [], [], [], []
            for t in batch.column(1):
                ids, text = c.coded(t.as_py())
                n.append(ids.count(",") + 1 if ids else 0)
                ids_hex.append(sha(ids.encode()).hexdigest())
                text_hex.append(sha(text.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    all_ids.append([int(x) for x in ids.split(",")] if ids else [])
                if with_text:
                    texts.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(code, kind)
