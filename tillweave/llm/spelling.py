"""Spelling variants: words that differ by one character, found by scanning sorted rotations of terminator-marked words."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.llm.tables import id_text, partitions, written

#: Marks the end of a word in its rotations; no word holds it.
END = "\0"
#: Latin-1 bytes: letters (and the two signs among them) stay, A-Z lower-cased, all else separates words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_HELD = 200_000  # distinct words that a task counts before it hands them on


def count_words(docs: DataFrame, *, erase_every: int | None = None, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """Words (maximal runs of A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of ``docs`` and how often each occurs: ``word``, ``n``.

    With ``erase_every``, a word whose crc32 of ``<doc_id>:<word>`` that number divides loses one character, at crc32 modulo
    its length: misspellings to test with. Words count after that, if they have ``least_chars`` code points and ``least_count``
    occurrences. Each task counts in a bounded table before anything is shuffled, so a very common word is a row per task.

    Defined cases: null and empty texts have no words; a null id counts as empty text; repeated rows count again; texts of any
    length are read whole; an empty table gives no rows; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            some = [(w.decode("latin-1"), n) for w, n in held.items() if len(w) >= least_chars]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split(b" "))
                words.pop(b"", None)
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in words.items():
                    if erase_every:
                        code = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if code % erase_every == 0:
                            word = word[: code % len(word)] + word[code % len(word) + 1 :]
                    held[word] += n
                if len(held) > _HELD:
                    yield counted()
        yield counted()

    rows = docs.select(id_text(F.col("doc_id")).alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """Sorted rotations of each marked word, with what a scan compares: ``prefix``, ``word``, ``n``, ``role``.

    The rotation that ends in character i is what follows i, the mark, and what precedes i. Without its last character it is
    the same for every word with another character there, and it is the whole rotation of the word that lacks i. So each word
    gives its whole rotations (role 0) and the prefixes that skip one character (role 1; 2 if that character is the first of a
    run of equal ones, as leaving out any other of the run gives the same word again).
    """
    marked, size = F.concat("word", F.lit(END)), F.length("word")
    turned = words.select("word", "n", marked.alias("marked"), F.explode(F.sequence(F.lit(0), size)).alias("at"))
    begin = F.expr("substring(marked, at + 1)")
    whole = turned.select(F.concat(begin, F.expr("substring(marked, 1, at)")).alias("prefix"), "word", "n", F.lit(0).alias("role"))
    repeats = F.expr("at > 1 and substring(word, at, 1) = substring(word, at - 1, 1)")
    skip = turned.where("at > 0").select(
        F.concat(begin, F.expr("substring(marked, 1, at - 1)")).alias("prefix"), "word", "n", F.when(repeats, 1).otherwise(2).alias("role")
    )
    return whole.unionByName(skip)


def _best(members: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The two members of largest count, ties in text order."""
    return sorted(members, key=lambda m: (-m[0], m[1]))[:2]


def near_in_group(members: list[tuple[str, int, int]]) -> list[tuple[str, int, str, int]]:
    """For the words (word, n, role) under one prefix: (word, how many are near it here, the best of them, its n)."""
    skips = [(n, word) for word, n, role in members if role]
    firsts = [(n, word) for word, n, role in members if role == 2]
    whole = [(n, word) for word, n, role in members if role == 0]
    top, top_first = _best(skips), _best(firsts)
    found = []
    for word, n, role in members:
        if role == 0:
            many, best = len(firsts), top_first[:1]
        else:
            other = whole if role == 2 else []
            many = len(skips) - 1 + len(other)
            best = _best([m for m in top if m[1] != word] + other)[:1]
        if many:
            found.append((word, many, best[0][1], best[0][0]))
    return found


def near_words(words: DataFrame) -> DataFrame:
    """Per word with a near one: ``word``, ``n_near`` (how many differ by one inserted, deleted or replaced character), ``best``
    (the near word of largest n, ties in code-point order), ``best_n``.

    The rotations are range-sorted and scanned group by group. A group has one word at most for each character of the alphabet
    and the shorter word, so it stays small however common its words are; every pair of near words meets in exactly one group.
    """
    order = rotations(words).repartitionByRange(partitions(words.sparkSession), "prefix").sortWithinPartitions("prefix")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # the last group, which may go on in the next batch

        def near(table: pa.Table) -> pa.RecordBatch:
            prefix = table.column("prefix").combine_chunks()
            differ = pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
            begins = [0, *(differ.nonzero()[0] + 1).tolist(), len(prefix)]
            found = []
            word, n, role = (table.column(c).combine_chunks() for c in ("word", "n", "role"))
            for low, high in zip(begins, begins[1:]):
                if high - low > 1:
                    part = [x.slice(low, high - low).to_pylist() for x in (word, n, role)]
                    found += near_in_group(list(zip(*part)))
            columns = list(zip(*found)) or [[]] * 4
            types = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["word", "many", "best", "best_n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([open_, table]) if open_ is not None else table
            same = pc.equal(table.column("prefix"), table.column("prefix")[-1])
            first = pc.index(same, True).as_py()
            open_ = table.slice(first)
            if first:
                yield near(table.slice(0, first))
        if open_ is not None:
            yield near(open_)

    found = order.mapInArrow(scan, "word string, many long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("many").alias("n_near"), best).select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.order")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """Where following ``form`` from ``word`` ends: ``word``, ``root``. Each round doubles the way, and writes it."""
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        stepped = found.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        stepped = written(stepped, "spelling-roots")
        found = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return found


def group_spellings(words: DataFrame, *, times: int = 2) -> DataFrame:
    """Spelling variants of ``words`` (``word``, ``n``; each word once): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    A word's form is its near word of largest n, if that is ``times`` as large as its own or more, else null; its root is where
    forms lead from it, itself if it has none. As n grows on the way, there are no cycles.

    Defined cases: words without a near one have n_near 0; equal counts go to the first word in code-point order; a null word is
    left out; an empty table gives none.
    """
    words = written(words.where("word is not null").select("word", "n"), "spelling-words")
    near = written(near_words(words), "spelling-near")
    formed = written(
        words.join(near, "word", "left").select(
            "word",
            F.when(F.col("best_n") >= times * F.col("n"), F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("best_n") >= times * F.col("n"), F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
