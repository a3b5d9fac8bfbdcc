"""Spelling variants: words of a vocabulary one edit apart, found by composing automata, and the usual form of each."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.common import ready
from cinderlog.sources.workspace import written

MIN_CHARS, MIN_COUNT, FORM_RATIO, EVERY = 7, 2, 10, 31
#: Groups of more words are divided further before they are composed.
GROUP_WORDS = 1 << 14
#: Distinct words a task counts before it hands its counts on.
MEMORY_WORDS = 1 << 18
#: What is no letter of A-Z, a-z, U+00C0 to U+00FF becomes a space (of texts in Latin-1, others are question marks there).
_LETTERS = bytes(b if chr(b).isascii() and chr(b).isalpha() or b >= 0xC0 else 0x20 for b in range(256))
MEMBER = "n int, side int, head int, tail int, pin boolean, part long, word string, uses long"


def misspelt(doc: bytes, run: bytes, every: int = EVERY) -> bytes:
    """A run of Latin-1 letters without one of them, if `every` divides its number in this document."""
    number = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(doc + b":"))
    if number % every:
        return run
    at = number % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, uses) of the words of all texts; each task counts its own first."""
    ready(docs.sparkSession)

    def handed(counts: Counter) -> pa.RecordBatch:
        words = pa.array([word.decode("latin-1") for word in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "uses"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                doc = b"" if doc is None else str(doc).encode()
                runs = text.encode("latin-1", "replace").lower().translate(_LETTERS).split()
                for run, uses in Counter(run for run in runs if len(run) >= min_chars).items():
                    word = misspelt(doc, run, every)
                    if len(word) >= min_chars:
                        counts[word] += uses
            if len(counts) > MEMORY_WORDS:
                yield handed(counts)
                counts.clear()
        yield handed(counts)

    texts = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("string").alias("doc_id"), docs["text"].cast("string").alias("text"))
    counted = texts.mapInArrow(count, "word string, uses long")
    return counted.groupBy("word").agg(F.sum("uses").alias("uses")).where(F.col("uses") >= min_count)


class Acceptor:
    """The minimal automaton of a sorted list of strings; a path's numbers add up to the place of its string in the list.

    `arcs[s]` maps a letter to (state, number), `final[s]` tells whether a string ends in s, `size[s]` how many go on from it.
    """

    def __init__(self, strings: list[str]):
        self.arcs, self.final, self.size, self._known = [], [], [], {}
        path = [[False, []]]  # per letter of the last string: whether a string ends there, and its arcs so far
        last = ""
        for string in strings:
            same = next((i for i, (a, b) in enumerate(zip(last, string)) if a != b), min(len(last), len(string)))
            self._freeze(path, last, same)
            path.extend([False, []] for _ in range(len(string) - same))
            path[-1][0] = True
            last = string
        self._freeze(path, last, 0)
        self.start = self._state(path[0])

    def _freeze(self, path: list, string: str, keep: int) -> None:
        for depth in range(len(path) - 1, keep, -1):
            path[depth - 1][1].append((string[depth - 1], self._state(path.pop())))

    def _state(self, node: list) -> int:
        key = (node[0], *node[1])
        if (known := self._known.get(key)) is not None:
            return known
        arcs, before = {}, int(node[0])
        for letter, state in node[1]:
            arcs[letter] = (state, before)
            before += self.size[state]
        self._known[key] = len(self.arcs)
        self.arcs.append(arcs)
        self.final.append(node[0])
        self.size.append(before)
        return len(self.arcs) - 1


def common(a: Acceptor, x: int, b: Acceptor, y: int, but: str | None = None) -> list[tuple[int, int]]:
    """Numbers in both automata of the strings that go on from state x of a and from state y of b; not those that begin with `but`."""
    found, stack, skipped = [], [(x, 0, y, 0)], but
    while stack:
        s, i, t, j = stack.pop()
        if a is b and s == t and skipped is None:
            found.extend((i + k, j + k) for k in range(a.size[s]))
            continue
        if a.final[s] and b.final[t]:
            found.append((i, j))
        theirs = b.arcs[t]
        for letter, (state, number) in a.arcs[s].items():
            if letter != skipped and letter in theirs:
                stack.append((state, i + number, theirs[letter][0], j + theirs[letter][1]))
        skipped = None
    return found


def replaced(a: Acceptor) -> Iterator[tuple[int, int]]:
    """Pairs of strings of one automaton with one letter replaced: the automaton, the edit and the automaton again, composed.

    Until the edit both run through the same states; behind it they read the same letters.
    """
    known, stack = {}, [(a.start, 0)]
    while stack:
        state, base = stack.pop()
        arcs = list(a.arcs[state].values())
        for k, (x, i) in enumerate(arcs):
            stack.append((x, base + i))
            for y, j in arcs[k + 1 :]:
                pairs = known.get((x, y))
                if pairs is None:
                    pairs = known[(x, y)] = common(a, x, a, y)
                for p, q in pairs:
                    yield base + i + p, base + j + q


def inserted(a: Acceptor, b: Acceptor) -> Iterator[tuple[int, int]]:
    """Pairs of a string of a and one of b that has a letter more; the letter counts as inserted where they first differ."""
    stack = [(a.start, 0, b.start, 0)]
    while stack:
        s, i, t, j = stack.pop()
        ours, theirs = a.arcs[s], b.arcs[t]
        for letter, (state, number) in theirs.items():
            for p, q in common(a, s, b, state, letter):
                yield i + p, j + number + q
            if letter in ours:
                stack.append((ours[letter][0], i + ours[letter][1], state, j + number))


def near_pairs(words: list[str], n: int, side: int, head: int, tail: int, pin: bool) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart among words of n letters, and of these with words of n + 1.

    All begin with the same `head` letters and end with the same `tail` letters, which the automata leave out. With
    side 1 the words are spelt backwards, and pairs that share the first half of the word as it is written are left to
    side 0. With `pin`, only pairs that first differ behind the head count.
    """
    short, long = (sorted((w[head : size - tail], w) for w in words if len(w) == size) for size in (n, n + 1))
    if not short:
        return
    a = Acceptor([rest for rest, _ in short])
    if len(short) > 1:
        for i, j in replaced(a):
            yield short[i][1], short[j][1]
    if long:
        half = n // 2
        for i, j in inserted(a, Acceptor([rest for rest, _ in long])):
            u, v = short[i][1], long[j][1]
            if (pin and u[head : head + 1] == v[head]) or (side and u[n - half :] == v[n + 1 - half :]):
                continue
            yield u, v


def _part(n: Column, side: Column, head: Column, tail: Column, pin: Column, word: Column) -> Column:
    rest = F.when(tail > 0, F.expr("right(word, tail)")).otherwise("")
    return F.xxhash64(n, side, head, tail, pin, word.substr(F.lit(1), head), rest)


def _members(words: DataFrame) -> DataFrame:
    """Each word with every state that it can begin a composition in, as rows of MEMBER.

    Words of n letters meet those of n and n + 1: where they first differ in the second half they share the first half
    (side 0), otherwise the last half, which is the first of the words spelt backwards (side 1).
    """
    size = F.char_length("word")
    starts = [F.struct((size - less).alias("n"), F.lit(side).alias("side")) for less in (0, 1) for side in (0, 1)]
    rows = words.select("word", "uses", F.explode(F.array(*starts)).alias("at")).select("at.*", "word", "uses").where("n >= 0")
    rows = rows.withColumn("word", F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word")))
    half = F.floor(F.col("n") / 2).cast("int")
    rows = rows.withColumn("head", F.when(F.col("side") == 1, F.col("n") - half).otherwise(half))
    return _shaped(rows.withColumns({"tail": F.lit(0), "pin": F.lit(False)}))


def _shaped(rows: DataFrame) -> DataFrame:
    part = _part(*[F.col(name) for name in ("n", "side", "head", "tail", "pin", "word")])
    return rows.withColumn("part", part).select("n", "side", "head", "tail", "pin", "part", "word", "uses")


def _divided(rows: DataFrame) -> DataFrame:
    """Groups that hold too many words, divided by two more letters of the head.

    Pairs that first differ in those two letters are pinned: they share what lies before and behind, so that such a
    group holds a word per letter of the alphabet, or two letters where one word is longer.
    """
    n, head = F.col("n"), F.col("head")
    pins = [F.when(head + k <= n, F.struct((head + k).alias("head"), F.greatest(n - head - k - 1, F.lit(0)).alias("tail"), F.lit(True).alias("pin"))) for k in (0, 1)]
    deeper = F.when(head + 2 <= n, F.struct((head + 2).alias("head"), F.lit(0).alias("tail"), F.lit(False).alias("pin")))
    ways = rows.withColumn("way", F.explode(F.filter(F.array(*pins, deeper), lambda way: way.isNotNull())))
    return _shaped(ways.select("n", "side", "way.*", "word", "uses"))


def bounded_groups(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """Rows of MEMBER in which no group that is not pinned holds more than group_words words, whatever the words are."""
    rows, done = _members(words), None
    while True:
        hot = written(rows.where("not pin").groupBy("part").count().where(F.col("count") > group_words).select("part"), "large-groups")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        rows = written(rows, "members")
        rest = rows.join(hot, "part", "left_anti").select(*rows.columns)
        done = rest if done is None else done.unionByName(rest)
        rows = _divided(rows.join(hot, "part", "left_semi").select(*rows.columns))


def _near_words(members: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): what each word meets in one group. Groups come one after another, sorted, in a task."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch[name].to_pylist() for name in ("part", "n", "side", "head", "tail", "pin", "word", "uses")])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, same_part in groupby(rows_of(batches), lambda row: row[0]):
            groups = {}
            for _, n, side, head, tail, pin, word, uses in same_part:  # the hash of a group may be that of another
                key = (n, side, head, tail, pin, word[:head], word[len(word) - tail :])
                groups.setdefault(key, {})[word] = uses
            for (n, side, head, tail, pin, *_), uses in groups.items():
                if len(uses) < 2:
                    continue
                met = {}
                for u, v in near_pairs(list(uses), n, side, head, tail, pin):
                    for word, other in ((u, v), (v, u)):
                        form = (-uses[other], other[::-1] if side else other)
                        known = met.get(word)
                        met[word] = (1, form) if known is None else (known[0] + 1, min(known[1], form))
                out.extend((word[::-1] if side else word, count, -form[0], form[1]) for word, (count, form) in met.items())
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        yield _batch(out)

    dealt = members.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(compose, "word string, n_near long, form_n long, form string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    word, count, form_n, form = zip(*rows) if rows else ((), (), (), ())
    arrays = [pa.array(word, pa.string()), pa.array(count, pa.int64()), pa.array(form_n, pa.int64()), pa.array(form, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "form_n", "form"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last, each round twice as far.

    A form is used ten times as often as its word or more, so there are no cycles and at most 19 steps, hence six rounds.
    """
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if found.join(further, "root", "left_semi").isEmpty():
            return found
        found = written(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def spelling_variants(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO,
    every: int = EVERY, group_words: int = GROUP_WORDS,
) -> DataFrame:
    """The words of all texts with the words one edit apart: word, n, n_near, form, form_n, root.

    docs: doc_id, text. A run is a maximal stretch of A-Z, a-z and U+00C0 to U+00FF, of which A-Z become small. Where
    `every` divides the CRC-32 of `<doc_id>:<run>` (a null doc_id is written as nothing), the run loses the letter at
    that number modulo its length. Words are the results of min_chars letters or more that occur min_count times or
    more, repeated rows counted. Two words are near if one letter put in, left out or replaced makes one the other. The
    form of a word is its most frequent near word (ties: the first in code-point order) if that has at least `ratio` (10
    or more) times its n; the root is the last of the forms. Null and empty texts have no words; very long runs are
    words like any other; an empty table gives no rows; other columns are left out.

    The vocabulary is divided by the states that a composition begins in (a half of a word); groups above group_words
    words are divided by further letters, so that neither a common beginning nor a common word gathers in one task.
    """
    if ratio < 10:
        raise ValueError("ratio must be 10 or more")
    words = written(vocabulary(docs, min_chars, min_count, every), "vocabulary")
    met = _near_words(bounded_groups(words, group_words))
    none = words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"), "uses")
    every_word = met.withColumn("uses", F.lit(None).cast("long")).unionByName(none)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), "form"))).alias("best")
    rows = every_word.groupBy("word").agg(F.max("uses").alias("n"), F.sum("n_near").alias("n_near"), best)
    usual = -F.col("best.n") >= ratio * F.col("n")
    rows = rows.select("word", "n", "n_near", F.when(usual, F.col("best.form")).alias("form"), F.when(usual, -F.col("best.n")).alias("form_n"))
    rows = written(rows, "near-words")
    chains = roots(rows.where("form is not null"))
    return rows.join(chains, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "n", "n_near", "form", "form_n", "root")
