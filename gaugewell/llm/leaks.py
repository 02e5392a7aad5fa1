"""Passages of evaluation items inside a corpus, by one Aho-Corasick automaton over words.

Items and texts are normalised alike: NFKC, removal of format characters (Cf), lower case; words are the maximal runs of
letters and numbers, and what stands between them is ignored.  The automaton's patterns are all runs of ``min_words``
words of the items, over word numbers, so one pass over a text finds every passage that it shares with any item, in whole
or in part.  Positions are mapped back to the text as stored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_GAP = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
_ASCII = str.maketrans({i: (chr(i).lower() if chr(i).isalnum() else " ") for i in range(128)})
#: Characters of items that one automaton takes (about 106 MB a worker for each million); more are spread over several
#: passes, all of which find the same as one would.
BLOCK_CHARS = 2_000_000


@lru_cache(maxsize=1)
def _classes() -> tuple[re.Pattern, re.Pattern, frozenset[str]]:
    """By rule, from the character database: format characters; characters that ``re`` sorts otherwise than the classes
    L and N; characters that may join the one before them when a text is normalised."""
    formats, odd, joins = [], [], set()
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Cf":
            formats.append(c)
        if (kind[0] in "LN") != c.isalnum():
            odd.append(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            joins.add(chr(int(parts[1], 16)))
    joins |= {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # Hangul vowels and finals
    none = re.compile(r"(?!)")
    pick = lambda cs: re.compile("[" + re.escape("".join(cs)) + "]") if cs else none
    return pick(formats), pick(odd), frozenset(joins)


def normalised(text: str) -> str:
    """The text after NFKC, without format characters, in lower case."""
    text = unicodedata.normalize("NFKC", text)
    return _classes()[0].sub("", text).lower()


def words_of(text: str) -> list[str]:
    """The words of a text as stored."""
    if text.isascii():
        return text.translate(_ASCII).split()
    text = normalised(text)
    if _classes()[1].search(text):
        import regex

        return regex.findall(r"[\p{L}\p{N}]+", text)
    return _GAP.sub(" ", text).split()


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Where in the text as stored each word of ``words_of`` begins and ends.

    The text is cut where normalising can't join what is left and right of the cut; a character of the result lies where
    its part lies.
    """
    formats, odd, joins = _classes()
    marks: list[tuple[int, int]] = []
    out: list[str] = []
    start = 0
    for k in range(1, len(text) + 1):
        if k < len(text):
            first = unicodedata.normalize("NFKD", text[k])[:1]
            if unicodedata.combining(first) or first in joins:
                continue
        part = formats.sub("", unicodedata.normalize("NFKC", text[start:k]))
        for c in part:
            marks += [(start, k)] * len(c.lower())
        out.append(part)
        start = k
    whole = "".join(out).lower()
    if odd.search(whole):
        import regex

        found = regex.finditer(r"[\p{L}\p{N}]+", whole)
    else:
        found = _WORD.finditer(whole)
    return [(marks[m.start()][0], marks[m.end() - 1][1]) for m in found]


class Automaton:
    """All runs of ``min_words`` words of the items: item k is ((id, field), text).

    Fields named by ``whole`` that have fewer words are looked for as they are, in texts that have a run of the same id.
    """

    def __init__(self, items: list[tuple[tuple[object, str], str]], min_words: int, whole: tuple[str, ...] = ()):
        import ahocorasick

        self.items, self.size = items, min_words
        self.numbers: dict[str, int] = {}
        runs: dict[tuple, set[int]] = {}
        self.short: dict[object, dict[tuple, int]] = {}
        for k, ((item, field), text) in enumerate(items):
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text))
            for i in range(len(ids) - min_words + 1):
                runs.setdefault(ids[i : i + min_words], set()).add(k)
            if field in whole and 0 < len(ids) < min_words:
                self.short.setdefault(item, {}).setdefault((field, ids), k)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for run, owners in runs.items():
            self.machine.add_word(run, tuple(sorted(owners)))
        if runs:
            self.machine.make_automaton()
        self.empty = not runs

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(item, first word, last word) of each longest shared passage, and of each place of a short field beside one."""
        if self.empty:
            return []
        words = words_of(text)
        if len(words) < self.size:
            return []
        numbers = tuple(map(self.numbers.get, words, repeat(0)))
        open_: dict[int, list[int]] = {}
        done = []
        for end, owners in self.machine.iter(numbers):
            for k in owners:
                at = open_.get(k)
                if at is not None and at[1] == end - 1:
                    at[1] = end
                else:
                    if at is not None:
                        done.append((k, *at))
                    open_[k] = [end - self.size + 1, end]
        done += [(k, *at) for k, at in open_.items()]
        for item in {self.items[k][0][0] for k, _, _ in done} & self.short.keys():
            for (_, ids), k in self.short[item].items():
                done += [(k, i, i + len(ids) - 1) for i, n in enumerate(numbers) if n == ids[0] and numbers[i : i + len(ids)] == ids]
        return done


_MACHINES: dict[str, Automaton] = {}


def _machine(key: str, items: list[tuple[tuple[object, str], str]], min_words: int, whole: tuple[str, ...]) -> Automaton:
    """One automaton a worker is kept, that of the block it scans."""
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = Automaton(items, min_words, whole)
    return _MACHINES[key]


def find_leaks(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    fields: tuple[str, ...] = ("prompt", "answer"), min_words: int = 12, offsets: bool = True, block_chars: int = BLOCK_CHARS,
    whole: tuple[str, ...] = (),
) -> DataFrame:
    """Every passage of at least ``min_words`` consecutive words that a text shares with a field of an item.

    With ``offsets``: id, item id, field, words, start_char and end_char (code points of the text as stored, end
    exclusive), one row for each longest passage; otherwise the distinct (id, item id).

    A field of fewer words shares nothing, unless ``whole`` names it: then each place of it, as a whole, in a text that
    shares a passage with the same item is a row too.  Null and empty texts and fields share nothing.  Repeated rows are found as
    often as they occur with offsets, once without.  Items of one id count as one.  Columns not named are not read; if both ids have one name, that of the item
    gets ``item_`` before it.

    The items are a stated query set.  Their size is measured first; each ``block_chars`` characters of them are one
    automaton and one pass over the texts, so what a task is sent stays bounded however many items there are.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    flat = items.select(F.col(item_col), F.inline(pairs))
    flat = flat.where(F.length("value") > 0).distinct()
    chars = flat.agg(F.sum(F.length("value"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    item_type = items.schema[item_col].dataType
    item_name = item_col if item_col.lower() != id_col.lower() else "item_" + item_col
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(item_name, item_type)])
    if offsets:
        schema = T.StructType([*schema.fields, T.StructField("field", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("words", "start_char", "end_char")]])
    names = schema.fieldNames()
    texts = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).where(F.length("_text") > 0)
    types = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
    out = None
    for block in range(blocks):
        rows = flat.where(F.pmod(F.xxhash64(item_col), F.lit(blocks)) == block).collect()
        held = [((r[0], r[1]), r[2]) for r in rows]
        key = hashlib.sha256(repr((held, min_words, whole)).encode("utf-8", "surrogatepass")).hexdigest()

        def run(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            machine = _machine(key, held, min_words, whole)
            for batch in batches:
                owner, cols = [], [[] for _ in names[1:]]
                for k in range(batch.num_rows):
                    text = batch.column(1)[k].as_py()
                    found = machine.scan(text)
                    if not found:
                        continue
                    if not offsets:
                        for item in {held[i][0][0] for i, _, _ in found}:
                            owner.append(k)
                            cols[0].append(item)
                        continue
                    at = word_offsets(text)
                    for i, a, b in found:
                        owner.append(k)
                        for c, x in zip(cols, (held[i][0][0], held[i][0][1], b - a + 1, at[a][0], at[b][1])):
                            c.append(x)
                if owner:
                    arrays = [batch.column(0).take(pa.array(owner, pa.int64()))]
                    arrays += [pa.array(c, t) for c, t in zip(cols, types)]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

        got = texts.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out if offsets else out.distinct()
