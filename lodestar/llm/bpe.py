"""BPE encoding and decoding by per-prefix dynamic programming (operator 8).

For every prefix of a piece of text exactly one token can be the last of its encoding. An automaton of all vocabulary
strings with suffix links gives, at each position, the tokens that are suffixes of the prefix, longest first; a token
is the last one if the encoding of what precedes it ends in a token that is *compatible*: the pair, encoded by the
merge rules on its own, stays these two tokens. The last token is stored for each prefix, and the back-pointers from
the whole piece give exactly the ids that applying merges in rank order would give. Decoding concatenates the ids'
byte strings.

The text is first cut as the tokenizer's pre-tokeniser cuts it. Encoded units are memoised per Python worker, up to
MEMO units (then the memo starts anew): that bounds memory and changes no result. Rows are independent: no shuffle.

Edge cases: a null or empty text has no ids; the tokenizer's special tokens found in the text are taken as such, as
the library does; very long texts and units are linear in their length; repeated rows are encoded alike; an empty
table gives no rows; other columns are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

MEMO, HEAD = 250_000, 6
#: Fixed value: the public byte-level pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A lone space or line feed between non-spaces always ends a piece; cutting there first makes units that repeat.
_LINE, _SPACE = re.compile(r"(?<=\S)\n(?=\S)"), re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte: itself if printable, else 256 upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBPE:
    """A byte-level BPE vocabulary file, its automaton and the memos."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in self.special}
        ids = {s: i for i, s in self.strings.items()}
        #: (left, right) -> (rank, merged) and merged -> (rank, left, right)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge[left, right] = rank, whole
            self.made.setdefault(whole, (rank, left, right))
        self.tokens, self.prefixes = ids, {s[:n] for s in ids for n in range(len(s) + 1)}
        #: The automaton: a state is the longest suffix read so far that begins a token; states and steps are made as
        #: they are met. ends[state]: the tokens that are suffixes there, longest first.
        self.names: list[bytes] = [b""]
        self.number: dict[bytes, int] = {b"": 0}
        self.steps: dict[int, int] = {}
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.decodes = self.strings | {i: s.encode() for s, i in self.special.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.pairs: dict[int, bool] = {}
        self.heads: dict[bytes, tuple[list[int], list[int], int]] = {}
        self.known: dict[str, tuple[int, bytes, bytes]] = {}
        #: Units after a space, and those at the start of a line.
        self.memo: dict[str, tuple[int, bytes, bytes]] = {}
        self.first: dict[str, tuple[int, bytes, bytes]] = {}

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the pair stays as it is when its bytes are encoded together.

        Both tokens are taken apart from their latest merge backwards; at each moment the pieces that face each other
        must not have a merge that would have been applied before they were built into larger ones.
        """
        bound = len(self.made) + 1  # the merge that next joined one of the facing pieces; ranks from here up come too late
        last_right = False  # the later merge was on the right: at equal rank the left one goes first
        while True:
            joined = self.merge.get((left, right))
            if joined and (joined[0] < bound or joined[0] == bound and last_right):
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                bound, left, last_right = a[0], a[2], False
            else:
                bound, right, last_right = b[0], b[1], True

    def _step(self, state: int, byte: int) -> int:
        name = self.names[state] + bytes((byte,))
        while name not in self.prefixes:  # the suffix link
            name = name[1:]
        to = self.number.get(name)
        if to is None:
            to = self.number[name] = len(self.names)
            self.names.append(name)
            self.ends.append(tuple((n, self.tokens[t]) for n in range(len(name), 0, -1) if (t := name[len(name) - n :]) in self.tokens))
        self.steps[state << 8 | byte] = to
        return to

    def _prefixes(self, piece: bytes, begun: tuple) -> tuple[list[int], list[int], int]:
        """For every prefix its last token and where that starts, going on from ``begun``; and the automaton's state."""
        last, back, state = begun[0][:], begun[1][:], begun[2]
        steps, ends, pairs, end = self.steps.get, self.ends, self.pairs, len(last) - 1
        for byte in piece[end:]:
            to = steps(state << 8 | byte)
            state = self._step(state, byte) if to is None else to
            end += 1
            for size, token in ends[state]:
                start = end - size
                if start:
                    pair = last[start] << 20 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) > 2 * MEMO:
                            pairs.clear()
                        fits = pairs[pair] = self._compatible(last[start], token)
                    if not fits:
                        continue
                last.append(token)
                back.append(start)
                break
        return last, back, state

    def ids(self, piece: bytes) -> list[int]:
        """The ids of one piece. What holds for a prefix holds in every piece that begins so: HEAD bytes are memoised."""
        head = piece[:HEAD]
        begun = self.heads.get(head)
        if begun is None:
            if len(self.heads) >= MEMO // 4:
                self.heads.clear()
            begun = self.heads[head] = self._prefixes(head, ([0], [0], 0))
        last, back, _ = self._prefixes(piece, begun) if len(piece) > HEAD else begun
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _piece(self, piece: str) -> tuple[int, bytes, bytes]:
        """Of a piece: number of ids, the ids written in decimal with commas, their bytes decoded."""
        ids = self.ids(piece.encode("utf-8", "surrogatepass"))
        found = len(ids), ",".join(map(str, ids)).encode(), b"".join([self.decodes[i] for i in ids])
        if len(self.known) >= MEMO:
            self.known.clear()
        if len(piece) <= 64:
            self.known[piece] = found
        return found

    def _unit(self, word: str, space: str = " ") -> tuple[int, bytes, bytes]:
        """The same of a unit of one or more pieces."""
        parts = [self.known.get(p) or self._piece(p) for p in self.pieces.findall(space + word)]
        if len(parts) == 1:
            found = parts[0]
        else:
            found = sum([p[0] for p in parts]), b",".join([p[1] for p in parts]), b"".join([p[2] for p in parts])
        memo = self.memo if space else self.first
        if len(memo) >= MEMO:
            memo.clear()
        if len(word) <= 64:
            memo[word] = found
        return found

    def units(self, text: str) -> list[tuple[int, bytes, bytes]]:
        out, memo = [], self.memo.get
        for i, plain in enumerate(self.cut_special.split(text) if self.cut_special else [text]):
            if i % 2:
                token = self.special[plain]
                out.append((1, b"%d" % token, self.decodes[token]))
                continue
            if not plain:
                continue
            for j, line in enumerate(_LINE.split(plain)):
                words = line.split(" ")
                if "" in words:  # spaces side by side, first or last
                    words = _SPACE.split(line)
                if j:
                    out.append(self.first.get("\n") or self._unit("\n", ""))
                out.append(self.first.get(words[0]) or self._unit(words[0], ""))
                found = list(map(memo, words[1:]))
                if None in found:
                    found = [f or self._unit(w) for f, w in zip(found, words[1:])]
                out += found
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for n, ids, _ in self.units(text or "") if n for i in ids.split(b",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.decodes.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        units = self.units(text or "")
        decoded = b"".join([u[2] for u in units]).decode("utf-8", "replace").encode()
        return sum([u[0] for u in units]), hashlib.sha256(b",".join([u[1] for u in units if u[0]])).hexdigest(), hashlib.sha256(decoded).hexdigest()


_LOADED: dict[str, PrefixBPE] = {}


def loaded(path: str) -> PrefixBPE:
    """One vocabulary per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBPE(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` plus token_ids."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path)
        for texts in batches:
            yield pd.Series([bpe.encode(t) for t in texts])

    return docs.withColumn("token_ids", run(F.col(text)))


def decode(tokens: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """``tokens`` plus decoded."""
    text_batches(tokens.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path)
        for rows in batches:
            yield pd.Series(["" if r is None else bpe.decode(list(r)) for r in rows], dtype=object)

    return tokens.withColumn("decoded", run(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; ids are encoded and decoded without leaving the task."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for texts in batches:
            yield pd.DataFrame([bpe.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", run(F.col("text")).alias("d")).select("doc_id", "d.*")
