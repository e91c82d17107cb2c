"""Token counts of whole texts: pre-tokens that are proven to be one token are counted, and only the rest is merged.

``whole_tokens`` proves once, on the driver, which strings of the vocabulary the merge model gives
back as one token; they are sent to the tasks (one list as long as the vocabulary, whatever the
corpus). A text is split by the pre-tokeniser's published pattern; a pre-token on the list
counts one, any other goes through the library's merge model, whose counts are kept for
``KEPT`` short ones. Strings of added tokens count one each, as the library takes them by default.

The pattern asks only whether characters are letters, numbers, white space or none of them. A
character outside ``_PLAIN`` is asked of the library's own pre-tokeniser the first time a
worker sees it, and a text with one that the two tell differently (another Unicode version) goes through
the library whole. So counts equal ``len(encode(text, add_special_tokens=False).ids)``; tests hold them against it.

Defined cases: null and empty texts have no token; rows that repeat are each counted; a null doc_id
stays; an empty table gives no row; other columns are ignored. Texts of any length are counted whole, ``_CHARS``
characters at a time where a cut is safe (before a single space between ASCII letters or digits).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import binary, common, tokens

LIMIT = 1024
#: Merged pre-tokens whose counts a worker keeps, and the longest of them; characters split at once.
KEPT, LONGEST, _CHARS = 250_000, 64, 1 << 20
#: Characters on whose classes all Unicode versions agree: ASCII and Latin-1 without controls, U+00A0 and the soft hyphen.
_PLAIN = re.compile("[ -~¡-¬®-ÿ\\n]*").fullmatch
_WIDE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
_CUT = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])").search
_counters: dict[str, Counter] = {}


def _of_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(256) if regex.fullmatch(kind, chr(c)))


#: The same pattern for plain characters, with the classes written out.
_NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_of_class(r'\p{L}')}]+| ?[{_of_class(r'\p{N}')}]+| ?[^ \n{_of_class(r'[\p{L}\p{N}]')}]+|[ \n]+(?![^ \n])|[ \n]+").findall


def whole_tokens(path: str) -> list[str]:
    """The strings of the vocabulary (in byte letters) that the merge model leaves as one token."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    merge = t.model.tokenize
    return sorted(v for v in t.get_vocab(with_added_tokens=False) if len(merge(v)) == 1)


class Counter:
    def __init__(self, path: str, whole: list[str]):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.split = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)")
        #: Added tokens that reach beyond their own string, or into each other, are left to the library.
        self.simple = len(added) < 2 and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = lambda piece: piece.translate(tokens._BYTES) if _PLAIN(piece) else level(piece)[0][0]
        self.count = self._counts(whole)
        self.agreed: set[str] = set()
        self.merged = 0

    def _counts(self, whole: list[str]) -> dict[str, int]:
        from tokenizers import decoders

        counter, limit, text_of = self, KEPT + len(whole), decoders.ByteLevel().decode

        class Counts(dict):
            def __missing__(self, piece: str) -> int:
                counter.merged += 1
                n = len(counter.merge(counter.letters(piece)))
                if len(piece) <= LONGEST and len(self) < limit:
                    self[piece] = n
                return n

        # A string that is part of a character only is no pre-token.
        return Counts((t, 1) for v, t in ((v, text_of([v])) for v in whole) if self.letters(t) == v)

    def _agrees(self, c: str) -> bool:
        """Whether the library and the pattern put a character into one class."""
        told = [len(self.split(x + c)) == 1 for x in "a1!"]
        return told == [regex.fullmatch(k, c) is not None for k in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = _NARROW
        if not _PLAIN(text):
            new = set(text) - self.agreed
            self.agreed |= {c for c in new if self._agrees(c)}
            if new - self.agreed:
                return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            parts = _WIDE
        n = 0
        if self.added.search(text):
            if not self.simple:
                return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            pieces = self.added.split(text)
            n = len(pieces) - 1
        else:
            pieces = [text]
        count = self.count.__getitem__
        for piece in pieces:
            at = 0
            while at < len(piece):
                cut = _CUT(piece, at + _CHARS)
                to = cut.start() if cut else len(piece)
                n += sum(map(count, parts(piece[at:to])))
                at = to
        return n


def counter(path: str, whole: list[str]) -> Counter:
    """One for each worker process."""
    if path not in _counters:
        _counters[path] = Counter(path, whole)
    return _counters[path]


def counted(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document."""
    common.ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, sent.value)
        for batch in batches:
            column = batch.column("text")
            n_bytes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            n = pa.array([count(t.as_py()) for t in column], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(common.table(spark, sf_dir, "documents"), binary.tokenizer_path())
