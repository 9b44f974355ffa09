"""Tokenizers as plug-ins, and anchors laid over the tokens of their sentence."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .markup import balanced

#: word, start, end (code points of the text), lemma.
Token = tuple[str, int, int, str]
#: What a caller can plug in: a function of a text. It is built in the worker's process if it comes from a factory.
Tokenizer = Callable[[str], Iterable[Token]]

#: A number with points or commas in it, a word, with what hyphens and apostrophes join to it, or a single sign.
WORD = r"\p{Nd}+(?:[.,]\p{Nd}+)+%?|[\p{L}\p{M}\p{N}_]+(?:[-'’][\p{L}\p{M}\p{N}_]+)*|[^\p{L}\p{M}\p{N}_\p{Z}\t\n\v\f\r]"
#: Bytes of text whose tokens are held at once; a longer text is held alone.
BLOCK = 1 << 20
#: Fixed value: what stands for a number.
NUMBER = "dddddd"
_word, _sign = regex.compile(WORD), regex.compile(r"[^\p{L}\p{M}\p{N}_]+")
_number = regex.compile(r"\p{Nd}+(?:[.,]\p{Nd}+)*%?")


def words_and_signs(text: str) -> Iterator[Token]:
    """The tokenizer that is there without a service: lemmas are the words."""
    return ((m[0], m.start(), m.end(), m[0]) for m in _word.finditer(text))


def _blocks(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most BLOCK bytes of the column's text, or of one row."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
        if i > start and held + n > BLOCK:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(batch) > start:
        yield batch.slice(start)


def tokenized(df: DataFrame, column: str, factory: Callable[[], Tokenizer] = lambda: words_and_signs, name: str = "tokens") -> DataFrame:
    """df with an array of tokens, in Arrow batches of a bounded size; null stays null. A task calls the factory once, so that a
    tokenizer may hold a dictionary or a connection that can't be sent."""
    at, names = df.columns.index(column), [*df.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = factory()
        for batch in batches:
            for rows in _blocks(batch, at):
                parts, offsets, texts = ([], [], [], []), [0], rows.column(at).to_pylist()
                for x in texts:
                    for token in () if x is None else tokenize(x):
                        for part, value in zip(parts, token):
                            part.append(value)
                    offsets.append(len(parts[0]))
                flat = [pa.array(part, kind) for part, kind in zip(parts, (pa.string(), pa.int32(), pa.int32(), pa.string()))]
                tokens = pa.StructArray.from_arrays(flat, ["word", "start", "end", "lemma"])
                found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens, mask=pa.array([x is None for x in texts]))
                yield pa.RecordBatch.from_arrays([*rows.columns, found], names)

    return df.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in df.dtypes) + f", `{name}` array<struct<word:string,start:int,end:int,lemma:string>>")


def _lower(text: str) -> str:
    """Lower case that moves no offset."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def token_anchors(text: str, tokenize: Tokenizer = words_and_signs, entity: Callable[[str], str | None] = lambda title: title) -> str:
    """A sentence as its lemmas in lower case, with [[entity|lemmas]] for each anchor. Signs go, and numbers become NUMBER. An anchor
    whose title has no entity is plain text, one without a token goes; a token that reaches into an anchor is part of it.
    By default titles are the entities; a large dictionary is joined to the titles before."""
    plain, spans, length, at = [], [], 0, 0
    for a, b in balanced(text):
        title, bar, label = text[a + 2 : b - 2].partition("|")
        label = label if bar else title
        plain += [text[at:a], label]
        length += a - at
        if label and (found := entity(title)) is not None:
            spans.append((length, length + len(label), found))
        length += len(label)
        at = b
    out: list[tuple[int, list[str]]] = []  # anchor's number, or -1, and lemmas
    k = 0
    for word, start, end, lemma in tokenize(_lower("".join(plain) + text[at:])):
        word = word.strip()
        if not word or _sign.fullmatch(word):
            continue
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        inside = k if k < len(spans) and end > spans[k][0] else -1
        lemma = NUMBER if _number.fullmatch(word) else lemma
        if out and out[-1][0] == inside:
            out[-1][1].append(lemma)
        else:
            out.append((inside, [lemma]))
    return " ".join(" ".join(lemmas) if i < 0 else f"[[{spans[i][2]}|{' '.join(lemmas)}]]" for i, lemmas in out)
