"""SentencePiece encoding and decoding (operator 1): shared-prefix Viterbi.

A text is cut into marked words, which no piece crosses. The distinct words of a batch are sorted, which is the order of a
depth-first walk over their trie, and each word begins with the forward states of the prefix it shares with the word
before it. A unigram model's forward state is the best score of the prefix and its last piece. A BPE model's is the last
piece alone: merging gives every prefix exactly one last piece, the longest one that merging leaves beside the last piece of
the prefix before it, and the best sum of scores is another result (README). So one walk serves both kinds of models, and
BPE results are those of merging. Words are cut, and told apart, by Arrow; Python meets the distinct ones.

Decoding joins the pieces' bytes, turns marks into spaces and drops the first one.
Defined results: null and empty texts have no ids and decode to an empty text; characters without a piece become byte pieces;
a text that holds the mark itself decodes with a space there; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import table, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of words whose ids are kept between steps, and pairs of pieces that are remembered.
CACHED, PAIRS = 6_000_000, 2_000_000
#: A state before the first character, as a piece; pieces' codes are below it.
START = (1 << 20) - 1
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


class Pieces:
    """A model's pieces and scores; read on the driver, sent to executors."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], unknown: int, special: set[int], kind: str = "bpe") -> None:
        self.pieces, self.scores, self.byte_ids, self.unknown, self.special, self.kind = pieces, scores, byte_ids, unknown, special, kind

    @classmethod
    def load(cls, path: str = MODEL, kind: str = "bpe") -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        byte_ids = [i for i in every if m.is_byte(i)]
        return cls([m.id_to_piece(i) for i in every], [m.get_score(i) for i in every], byte_ids, m.unk_id(), {i for i in every if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}, kind)


class Codec:
    """Encodes batches of texts; keeps the words it has met, up to CACHED of them."""

    def __init__(self, model: Pieces) -> None:
        self.kind, self.bytes_of = model.kind, model.byte_ids
        self.unknown = model.unknown
        usable = [(p, i) for i, p in enumerate(model.pieces) if i not in model.special and p]
        self.id_of = dict(usable)
        self.score = {p: model.scores[i] for p, i in usable}
        self.floor = min(self.score.values(), default=0.0) - 10.0
        # Pieces by code: the model's by id, characters without a piece behind them as they are met.
        self.pieces, self.lens, self.strange = list(model.pieces), [len(p) for p in model.pieces], {}
        # Every end of a piece, with its code where it is a piece itself: a search backwards stops where no piece ends so.
        self.tails = {p[k:]: -1 for p in self.id_of for k in range(1, len(p))} | self.id_of
        inner = set("".join(p[1:] for p in self.id_of)) | set("".join(p[:-1] for p in self.id_of if len(p) > 1))
        # Line feeds and tabs are words of their own unless a longer piece holds them.
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        self.single = "\n" in alone
        self.word = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        as_byte = {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
        raw = [as_byte.get(i, b"" if i in model.special else p.replace(MARK, " ").encode()) for i, p in enumerate(model.pieces)]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_len = np.array([len(r) for r in raw], dtype=np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)[:-1]])
        self.beside: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.held = 0
        self.index: dict[str, int] = {}
        self.ids: list[list[int]] = []
        self.flat, self.sizes = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        # Words of texts without runs of marks, as cut at spaces.
        self.plain: dict[str, int] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """BPE by merging, best score first, then leftmost; a queue of pairs keeps very long words in bounds."""
        left, n = list(symbols), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (s := self.score.get(left[i] + left[after[i]])) is not None:
                heapq.heappush(queue, (-s, i, left[i], left[after[i]]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            # A pair counts only while both of its pieces are still what they were.
            if left[i] != a or after[i] >= n or left[after[i]] != b:
                continue
            gone = after[i]
            left[i], left[gone], after[i] = a + b, "", after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in left if x]

    def stays(self, key: int) -> bool:
        """Whether merging leaves two pieces side by side as they are; the key holds both codes, START for no first piece."""
        if len(self.beside) > PAIRS:
            self.beside.clear()
        a, b = key >> 20, self.pieces[key & START]
        first = [] if a == START else [self.pieces[a]]
        known = self.beside[key] = self.merged([*"".join(first), *b]) == [*first, b]
        return known

    def _strange(self, character: str) -> int:
        code = self.strange.get(character)
        if code is None:
            code = self.strange[character] = len(self.pieces)
            self.pieces.append(character)
            self.lens.append(1)
        return code

    def walk(self, words: list[str]) -> list[list[int]]:
        """The pieces' codes of words, sorted: states[i] is the last piece of the prefix of i characters."""
        before, states, out = "", [START], []
        scores = None if self.kind == "bpe" else [0.0]
        tails, lens, beside, score = self.tails, self.lens, self.beside, self.score
        for word in words:
            same, top = 0, min(len(before), len(word))
            while same < top and word[same] == before[same]:
                same += 1
            del states[same + 1 :]
            if scores:
                del scores[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                j, fits = i - 1, []
                while j >= 0:
                    code = tails.get(word[j:i])
                    if code is None:
                        break
                    if code >= 0:
                        fits.append(code)
                    j -= 1
                if not fits or lens[fits[0]] > 1:
                    fits.insert(0, self._strange(word[i - 1]))
                if scores:
                    s, code = max((scores[i - lens[code]] + score.get(self.pieces[code], self.floor), code) for code in fits)
                    scores.append(s)
                else:
                    for code in reversed(fits):  # noqa: B007
                        key = states[i - lens[code]] << 20 | code
                        stays = beside.get(key)
                        if self.stays(key) if stays is None else stays:
                            break
                states.append(code)
            before, i, own = word, len(word), []
            while i:
                code = states[i]
                own.append(code)
                i -= lens[code]
            own.reverse()
            out.append(own)
        return out

    def _ids(self, codes: list[int]) -> list[int]:
        known = len(self.raw_len)
        if not codes or max(codes) < known:
            return codes
        ids: list[int] = []
        for code in codes:
            if code < known:
                ids.append(code)
            elif len(self.bytes_of) == 256:
                ids += [self.bytes_of[b] for b in self.pieces[code].encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.unknown)
        return ids

    def _learn(self, words: list[str], marked: bool) -> None:
        """Ids of new words, sorted. marked: words as they are met in texts, with their marks; else words to be marked."""
        direct = [w for w in words if marked and self.kind == "bpe" and w.startswith(MARK + MARK)]
        # Runs of marks are merged directly: their pieces have equal scores, so their order matters.
        for w in direct:
            self.index[w] = len(self.ids)
            self.ids.append(self._ids([self.id_of[p] if p in self.id_of else self._strange(p) for p in self.merged(list(w))]))
        rest = [w for w in words if w not in set(direct)] if direct else words
        target = self.index if marked else self.plain
        for w, codes in zip(rest, self.walk(rest if marked else [MARK + w for w in rest]), strict=True):
            target[w] = len(self.ids)
            self.ids.append(self._ids(codes))
        self.held += sum(map(len, words))

    def _at(self, words: list[str], easy: bool) -> np.ndarray:
        """Places of distinct words in self.ids."""
        if easy:
            new = [w for w in words if w not in self.plain]
            lines = [w for w in new if w[0] == "\n"]
            self._learn(sorted(({w[1:] for w in lines} | ({"\n"} if lines else set())) - {""} - self.index.keys()), True)
            self._learn(sorted(w for w in new if w[0] != "\n"), False)
            for w in lines:
                self.plain[w] = len(self.ids)
                self.ids.append(self.ids[self.index["\n"]] + (self.ids[self.index[w[1:]]] if len(w) > 1 else []))
        else:
            self._learn(sorted({*words} - self.index.keys()), True)
        return np.fromiter(map((self.plain if easy else self.index).__getitem__, words), dtype=np.int64, count=len(words))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.held > CACHED:
            self._clear()
        # A text with single spaces only is cut at them: each part is a word to be marked, or a line feed and a word without a mark.
        odd = pc.match_substring_regex(texts, f"^[\\x00-\\x20]| $|  | \n|{MARK}|\t|\r") if self.single else pa.array([True] * len(texts))
        blank, odd = (np.asarray(x.to_numpy(zero_copy_only=False), dtype=bool) for x in (pc.equal(texts, ""), odd))
        places, starts, counts, total = [], np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), 0
        for easy in (True, False):
            own = np.flatnonzero(~blank & (odd != easy))
            part = texts.take(pa.array(own))
            if easy:
                cut = pc.split_pattern(pc.replace_substring(part, "\n", " \n"), " ")
            else:
                cut = pa.array([self.word.findall(MARK + t.replace(" ", MARK)) for t in part.to_pylist()], pa.list_(pa.string()))
            many = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
            words = pc.list_flatten(cut).dictionary_encode()
            places.append(self._at(words.dictionary.to_pylist(), easy)[words.indices.to_numpy()])
            starts[own], counts[own] = total + np.cumsum(many) - many, many
            total += int(many.sum())
        added = self.ids[len(self.sizes) :]
        more = np.array([len(x) for x in added], dtype=np.int64)
        self.sizes = np.concatenate([self.sizes, more])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in added for i in x), dtype=np.int32, count=int(more.sum()))])
        at = np.concatenate(places)[spread(starts, counts)]
        first = np.cumsum(self.sizes) - self.sizes
        ids = self.flat[spread(first[at], self.sizes[at])]
        per_word = np.concatenate([[0], np.cumsum(self.sizes[at])])
        return ids, np.diff(per_word[np.cumsum(counts)], prepend=0)

    def raw_of(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts, each with the space of its first mark, and where they begin and end."""
        lens = self.raw_len[ids]
        data = self.raw[spread(self.raw_at[ids], lens)].tobytes()
        return data, np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(sizes)])]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        data, ends = self.raw_of(ids, sizes)
        return [data[a:b].decode("utf-8", "replace")[1:] for a, b in zip(ends, ends[1:], strict=False)]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[k], starts[k] + 1, ... (sizes[k] of them) for each k."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


#: A worker's codec, by the name of its encoding run.
_codecs: dict[str, Codec] = {}


def encoded(docs: DataFrame, model: Pieces | None = None, bytes_a_step: int = 4_000_000) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (whether the decoded ids are the text) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model or Pieces.load())
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = Codec(shared.value)
        codec = _codecs[key]
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1])
            step = (np.cumsum(sizes) - sizes) // bytes_a_step
            for at, end in zip(*(f(np.flatnonzero(np.diff(step, prepend=-1, append=step[-1:] + 1))) for f in (lambda x: x[:-1], lambda x: x[1:])), strict=True):
                ids, many = codec.encode(batch.column(1).slice(at, end - at))
                data, ends = codec.raw_of(ids, many)
                same = [data[a + 1 : b] == t.as_buffer() for a, b, t in zip(ends, ends[1:], column.slice(at, end - at), strict=False)]
                offsets = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(many), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(same, pa.bool_())], schema=OUT)

    return text_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decoded(df: DataFrame, model: Pieces | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    shared = df.sparkSession.sparkContext.broadcast(model or Pieces.load())

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            lists = [np.array(x or [], dtype=np.int64) for x in batch.column(1).to_pylist()]
            texts = codec.decode(np.concatenate([*lists, np.empty(0, dtype=np.int64)]), np.array([len(x) for x in lists], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
