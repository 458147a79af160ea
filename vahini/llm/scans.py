"""Problem 4: text layers of scanned pages repaired into continuous paragraphs, with the repairs listed.

1. Page-number lines by their forms; headers and footers by fuzzy repetition at page edges: over the whole corpus every
   line shape (digits and capitalised words abstracted) is counted, in all, at page edges, and in documents that repeat
   it. Shapes that live at edges and repeat are furniture; a line close to a furniture line of its document is too.
2. The corpus vocabulary (all words of `text` and the inner words of the scanned lines) decides how the halves of a
   divided word are joined, and which rare words are misreadings: a word and its usual misreadings (rn for m, 5 for s)
   have one skeleton, and a rare word is put right by a far more frequent one of its skeleton. Everything on the vocabulary is a join; only the furniture shapes and a
   bounded list of the most frequent sound words are sent to the workers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vahini.llm.latin import osa
from vahini.session import cut, spread

# Characters that recognisers take for each other, each with the one that stands for its class.
LIKE = {"1": "i", "!": "i", "|": "i", "l": "i", "0": "o", "@": "a", "5": "s", "$": "s", "9": "g", "c": "e", "8": "h", "6": "h", "b": "h", "f": "t"}
# Letters taken for two, put together after the classes (ei stands for cl). Pairs can overlap, so there are
# several orders; a word and its misreading agree in one of them.
PAIRS = {"ri": "n", "rn": "m", "ei": "d", "ii": "u", "ti": "h", "vv": "w"}
ORDERS = (("ri", "rn", "ei", "ii", "ti", "vv"), ("ii", "ri", "rn", "ei", "ti", "vv"), ("ti", "ii", "ri", "rn", "ei", "vv"))
# Letters in a number -> digits.
IN_NUMBERS = str.maketrans("lIOoSZBbgq|", "11005286991")
HYPHENS = "-‐‑­¬"
EDGES = " \t.,;:()[]{}\"'?“”‘’।"
#: A shape is furniture from this many lines on, with these shares at page edges and in documents that repeat it.
LEAST_LINES, LEAST_EDGE, LEAST_REPEAT = 3, 0.25, 0.5
#: A rare word is a misreading if the word behind it is so many times as frequent.
TIMES = 8
#: The most frequent sound words, which need no look-up. A bound for the message size only: other words are looked up in a join.
SOUND_WORDS = 20_000

_N = r"([0-9०-९OlISZBb]{1,6})"
PAGE = re.compile(
    rf"(?:[-–—]\s*{_N}\s*[-–—]|(?:पान|पृष्ठ)\s*(?:क्र\.?)?\s*{_N}|{_N}\s*\|\s*P\s?a\s?g\s?e|\[{_N}\]|P\s?a\s?g\s?e\s*(?:No\.?)?\s*{_N}(?:\s*of\s*{_N})?)", re.IGNORECASE
)
_NUMBER = re.compile(r"[0-9lIOoSZBbgq|]+(?:[.,/-][0-9lIOoSZBbgq|]+)*")
_MIXED = re.compile(r"[^\W\d_][0-9@!|$]|[0-9@!|$][^\W\d_]")


_GAPS, _ALL_DIGITS, _CAPITALS, _RUNS = re.compile(r"\s{2,}"), re.compile(r"[0-9०-९]+"), re.compile(r"[A-Z][\w.#]*"), re.compile(r"A( A)+")
_DIGITS, _DIGIT, _LETTER, _SEPARATOR = re.compile(r"\d+"), re.compile(r"\d"), re.compile(r"[a-zA-Z|]"), re.compile(r"[,/]")


def shape(line: str) -> str:
    s = _GAPS.sub("  ", line.strip())
    return _RUNS.sub("A+", _CAPITALS.sub("A", _ALL_DIGITS.sub("#", s)))


def like(a: str, b: str, most: int) -> bool:
    """At most so many edits apart. Letters that only one has tell most pairs apart: an edit brings in and takes away one at most."""
    if abs(len(a) - len(b)) > most:
        return False
    x, y = Counter(a), Counter(b)
    return (x - y).total() <= most and (y - x).total() <= most and osa(a, b, most) <= most


def page_edges(lines: list[str]) -> tuple[list[int], set[int], set[int]]:
    """Lines with text, page-number lines, and lines at an edge of a page."""
    full = [k for k, x in enumerate(lines) if x.strip()]
    pages = {k for k in full if PAGE.fullmatch(lines[k].strip())}
    edges = {full[0], full[-1]} if full else set()
    for p, k in enumerate(full):
        if k in pages:
            edges.update(full[max(0, p - 1) : p] + full[p + 1 : p + 2])
    return full, pages, edges - pages


def furniture(lines: list[str], shapes: frozenset[str], near: frozenset[str] = frozenset()) -> set[int]:
    """Indices of headers, footers and page numbers. ``near``: shapes at page edges that are misreadings of furniture shapes."""
    full, found, edges = page_edges(lines)
    sure = {k for k in full if k not in found and shape(lines[k]) in shapes}
    known = {_DIGITS.sub("#", lines[k].strip()) for k in sure}
    for k in full:
        if k in found or k in sure:
            continue
        text = _DIGITS.sub("#", lines[k].strip())
        if len(text) < 8:
            continue
        if any(abs(len(text) - len(x)) <= 3 and like(text, x, max(2, len(x) // 8)) for x in known):
            sure.add(k)
        elif k in edges and len(text) >= 12 and shape(lines[k]) in near:
            sure.add(k)
    numbered = found or any(re.search(r"\bPage\s*\d+\s*$", lines[k]) for k in sure)
    return found | sure | (set() if numbered else bare_numbers(lines, full, sure))


def bare_numbers(lines: list[str], full: list[int], sure: set[int]) -> set[int]:
    """Page numbers that stand alone: beside furniture or at the end, each one more than the one before. Rows of a table
    (under or over another number) are none, unless furniture follows."""
    lone = {k: int(lines[k].strip()) for k in full if re.fullmatch(r"[0-9०-९]{1,4}", lines[k].strip())}
    at = {k: p for p, k in enumerate(full)}

    def beside(k: int, by: int) -> int | None:
        p = at[k] + by
        return full[p] if 0 <= p < len(full) else None

    might = [k for k in lone if beside(k, 1) is None or beside(k, 1) in sure or beside(k, -1) in sure or (beside(k, -1) not in lone and beside(k, 1) not in lone)]
    best: list[int] = []
    for start in range(len(might)):
        chain = [might[start]]
        for k in might[start + 1 :]:
            if lone[k] == lone[chain[-1]] + 1:
                chain.append(k)
        if len(chain) > len(best):
            best = chain
    backed = [k for k in best if beside(k, 1) in sure or beside(k, -1) in sure]
    if len(best) >= 2 and (backed or beside(best[-1], 1) is None):
        return set(best)
    if len(best) != 1 or not backed:
        return set()
    above = beside(best[0], -1)
    in_table = above is not None and above not in sure and len(lines[above].strip()) <= 25
    return set() if in_table else set(backed)


@lru_cache(200_000)
def number(word: str) -> str | None:
    """A misread number set right; None if the word is no number or has nothing misread."""
    if not _DIGIT.search(word) or not _LETTER.search(word) or not _NUMBER.fullmatch(word):
        return None
    digits, letters = len(_DIGIT.findall(word)), len(_LETTER.findall(word))
    if letters > digits + 1 and not _SEPARATOR.search(word):
        return None
    return word.translate(IN_NUMBERS)


def body(text: str, shapes: frozenset[str], near: frozenset[str] = frozenset()) -> tuple[list[str], set[int], list[tuple[int, int, str, str]]]:
    """Lines, furniture, and divided words as (line, next line, first half, second half) with their words' edges stripped."""
    lines = text.split("\n")
    off = furniture(lines, shapes, near)
    kept = [k for k, x in enumerate(lines) if k not in off and x.strip()]
    divided = []
    for k, n in zip(kept, kept[1:]):
        s = lines[k].rstrip()
        if s and s[-1] in HYPHENS:
            left = s.split()[-1]
            right = lines[n].split()[0]
            first, second = left[:-1].lstrip(EDGES), right.rstrip(EDGES)
            if first and second and re.fullmatch(r"[^\W\d_].*", second[-1:] + "x") and re.search(r"[^\W_]$|[ऀ-ॿ]$", first):
                divided.append((k, n, first, second))
    return lines, off, divided


#: At most so many furniture shapes, misread ones included, are sent to the workers; if there are more, each document gets its own in a join.
MOST_SHAPES = 50_000
#: Shapes of at least so many characters can be misread; a misread one differs in at most EDITS (a swap of neighbours is one).
LEAST_SHAPE, EDITS = 12, 2
#: EDITS edits, swaps counted twice, leave one of so many segments whole.
SEGMENTS = 2 * EDITS + 1


def _counted(documents: DataFrame) -> DataFrame:
    """(shape, near): the furniture shapes of the corpus, and (near) shapes at page edges that are misreadings of one."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, edge, again = Counter(), Counter(), Counter()
        for b in batches:
            for t in b["ocr_text"]:
                lines = t.split("\n")
                full, pages, edges = page_edges(lines)
                mine = {k: shape(lines[k]) for k in full if k not in pages}
                times = Counter(mine.values())
                for k, s in mine.items():
                    every[s] += 1
                    edge[s] += k in edges
                    again[s] += times[s] > 1
            keep = list(every)
            yield pd.DataFrame({"shape": keep, "n": [every[s] for s in keep], "edge": [edge[s] for s in keep], "again": [again[s] for s in keep]})
            every, edge, again = Counter(), Counter(), Counter()

    counts = documents.mapInPandas(count, "shape string, n bigint, edge bigint, again bigint").groupBy("shape")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("edge").alias("edge"), F.sum("again").alias("again"))
    counts = counts.filter("edge > 0").withColumn("sure", (F.col("n") >= LEAST_LINES) & (F.col("edge") >= LEAST_EDGE * F.col("n")) & (F.col("again") >= LEAST_REPEAT * F.col("n")))
    counts = cut(counts.select("shape", "sure"))
    sure = counts.filter("sure").select("shape")
    return cut(sure.select("shape", F.lit(False).alias("near")).unionByName(_misread(counts.filter("NOT sure"), sure).withColumn("near", F.lit(True))))


def segments(n: int) -> list[tuple[int, int]]:
    """(begin, end) of the segments of a shape of n characters."""
    return [(n * i // SEGMENTS, n * (i + 1) // SEGMENTS) for i in range(SEGMENTS)]


def _misread(others: DataFrame, sure: DataFrame) -> DataFrame:
    """(shape): those of ``others`` at most EDITS edits from a furniture shape of LEAST_SHAPE characters or more.

    Every other shape sends its segments; a furniture shape sends, for each length that a misreading of it can have, what
    can stand in each segment, shifted by at most EDITS. So a pair within EDITS meets, and only the few furniture shapes
    send many keys.
    """

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, f"{len(s)}:{i}:{s[x:y]}") for s in b["shape"] if len(s) >= LEAST_SHAPE - EDITS for i, (x, y) in enumerate(segments(len(s)))]
            yield pd.DataFrame(rows, columns=["shape", "key"])

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {
                (s, f"{n}:{i}:{s[x + k:y + k]}") for s in b["shape"] if len(s) >= LEAST_SHAPE for n in range(len(s) - EDITS, len(s) + EDITS + 1)
                for i, (x, y) in enumerate(segments(n)) for k in range(-EDITS, EDITS + 1) if x + k >= 0 and y + k <= len(s)
            }
            yield pd.DataFrame(sorted(rows), columns=["like", "key"])

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[osa(x, y, EDITS) <= EDITS for x, y in zip(b["shape"], b["like"])]][["shape"]]

    pairs = spread(others).mapInPandas(own, "shape string, key string").join(sure.mapInPandas(sent, "like string, key string"), "key")
    return pairs.select("shape", "like").distinct().mapInPandas(close, "shape string").distinct()


def _own_shapes(documents: DataFrame, shapes: DataFrame) -> DataFrame:
    """Documents with the furniture shapes among their lines."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s) for d, t in zip(b["doc_id"], b["ocr_text"]) for s in {shape(x) for x in t.split("\n") if x.strip()}]
            yield pd.DataFrame(rows, columns=["doc_id", "shape"])

    mine = documents.mapInPandas(lines, "doc_id bigint, shape string").join(shapes, "shape").groupBy("doc_id").agg(
        F.collect_set(F.when(~F.col("near"), F.col("shape"))).alias("shapes"), F.collect_set(F.when(F.col("near"), F.col("shape"))).alias("near")
    )
    return documents.join(mine, "doc_id", "left")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s.,;:()\[\]{}\"'?“”‘’।]+|[\s.,;:()\[\]{}\"'?“”‘’।]+$", "")


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n, scanned): n counts words of ``text`` and the scanned lines' words that are neither first nor last (those
    may be halves); scanned counts all words of scanned lines."""
    tokens = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    lines = documents.select(F.explode(F.split("ocr_text", "\n")).alias("line")).select(tokens.alias("t"))
    scanned = lines.select(F.posexplode("t").alias("at", "w"), F.size("t").alias("of")).select(
        "w", ((F.col("at") > 0) & (F.col("at") < F.col("of") - 1)).cast("int").alias("n"), F.lit(1).alias("scanned")
    )
    plain = documents.select(F.explode(F.split("text", r"\s+")).alias("w")).select("w", F.lit(1).alias("n"), F.lit(0).alias("scanned"))
    words = plain.unionByName(scanned).groupBy("w").agg(F.sum("n").alias("n"), F.sum("scanned").alias("scanned"))
    stripped = words.select(_strip(F.col("w")).alias("word"), "n", "scanned").filter("word <> ''")
    return stripped.groupBy("word").agg(F.sum("n").alias("n"), F.sum("scanned").alias("scanned"))


def skeletons(word: Column) -> Column:
    """One for each order, as "order:skeleton": the same for a word and its usual misreadings."""
    classes = F.translate(F.lower(word), "".join(LIKE), "".join(LIKE.values()))
    out = []
    for k, order in enumerate(ORDERS):
        s = classes
        for two in order:
            s = F.replace(s, F.lit(two), F.lit(PAIRS[two]))
        out.append(F.concat(F.lit(f"{k}:"), s))
    return F.array(*out)


def misreadings(vocab: DataFrame) -> DataFrame:
    """(word, fixed, capital, small): scanned words with the far more frequent word of the same skeleton, in all and by the case
    of its first letter. A word with a digit or symbol beside a letter needs no such distance."""
    latin = vocab.filter(F.col("word").rlike(r"^[A-Za-z0-9@!|$'-]+$") & F.col("word").rlike("[A-Za-z]") & (F.length("word") > 1)).select(
        "word", F.greatest("n", F.lit(1)).alias("n"), "scanned", F.explode(skeletons(F.col("word"))).alias("skeleton"), F.col("word").rlike(r"[A-Za-z][0-9@!|$]|[0-9@!|$][A-Za-z]").alias("mixed")
    )
    first = F.substring("word", 1, 1)
    sound, order = ~F.col("mixed"), F.struct("n", "word")
    best = latin.groupBy("skeleton").agg(
        F.max_by("word", F.when(sound, order)).alias("fixed"), F.max(F.when(sound, F.col("n"))).alias("m"),
        F.max_by("word", F.when(sound & (first != F.lower(first)), order)).alias("capital"), F.max_by("word", F.when(sound & (first == F.lower(first)), order)).alias("small"),
    )
    rare = latin.filter("scanned > 0").join(best.filter("m IS NOT NULL"), "skeleton").filter("lower(word) <> lower(fixed)")
    rare = rare.filter((F.col("m") >= TIMES * F.col("n")) | F.col("mixed"))
    pick = F.max_by(F.struct("fixed", "capital", "small"), F.struct("m", "fixed", "skeleton"))
    return rare.groupBy("word").agg(pick.alias("p")).select("word", "p.*")


def repairs(documents: DataFrame, most_shapes: int = MOST_SHAPES) -> DataFrame:
    """(doc_id, line_no, kind, fixed), kinds furniture, hyphen and misread; lines counted from 1.

    NULL and empty layers have no repairs; texts without line ends are one line. A document row that repeats counts
    once. Whole texts are read.
    """
    return _repaired(documents, most_shapes).select("doc_id", "line_no", "kind", "fixed").distinct()


def paragraphs(documents: DataFrame, most_shapes: int = MOST_SHAPES) -> DataFrame:
    """(doc_id, paragraph, text, n_repairs): the layers as continuous paragraphs, counted from 1, with the repairs made.

    Furniture is left out, divided words are put together on the line where they begin, misread ones replaced. Blank and
    indented lines begin a paragraph, unless a page ends there in the middle of a sentence. ``n_repairs`` is the
    document's. Layers without any line left have no paragraph; of rows with one doc_id the first text counts.
    """
    one = documents.filter("ocr_text IS NOT NULL AND trim(ocr_text) <> ''").groupBy("doc_id").agg(F.min("ocr_text").alias("ocr_text"), F.first("text").alias("text"))
    made = _repaired(documents.select("doc_id", "ocr_text", "text"), most_shapes).distinct()
    made = made.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "kind", "typed", "fixed")).alias("made"))  # no more than a document's words

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, repaired in zip(b["doc_id"], b["ocr_text"], b["made"]):
                repaired = [] if repaired is None else [(r["line_no"], r["kind"], r["typed"], r["fixed"]) for r in repaired]
                rows += [(doc, k, p, len(repaired)) for k, p in enumerate(rebuilt(text, repaired), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "paragraph", "text", "n_repairs"])

    return one.select("doc_id", "ocr_text").join(made, "doc_id", "left").mapInPandas(read, "doc_id bigint, paragraph int, text string, n_repairs int")


def rebuilt(text: str, made: list[tuple[int, str, str, str]]) -> list[str]:
    """The paragraphs of a text after its repairs (line, kind, typed, fixed)."""
    off = {n for n, kind, _, _ in made if kind == "furniture"}
    whole = {n: fixed for n, kind, _, fixed in made if kind == "hyphen"}
    wrong = {(n, typed): fixed for n, kind, typed, fixed in made if kind == "misread"}
    out: list[list[str]] = []
    gap = page = carried = False
    for n, line in enumerate(text.split("\n"), 1):
        if n in off:
            page = True
            continue
        if not line.strip():
            gap = True
            continue
        words = []
        for raw in line.split():
            word = raw.strip(EDGES)
            words.append(raw.replace(word, wrong[n, word], 1) if (n, word) in wrong else raw)
        if carried:  # the second half stands on the line before; what follows it there too
            half = words.pop(0)
            out[-1][-1] += half[len(half.rstrip(EDGES)) :]
        carried = n in whole
        if carried:
            half = words.pop()
            words.append(half[: len(half) - len(half.lstrip(EDGES))] + whole[n])
        open_ = out and out[-1] and out[-1][-1][-1:] not in ".?!:।"
        if not out or ((gap or line[:1].isspace()) and not (page and open_)):
            out.append([])
        out[-1] += words
        gap = page = False
    return [" ".join(p) for p in out if p]


def _repaired(documents: DataFrame, most_shapes: int) -> DataFrame:
    """(doc_id, line_no, kind, typed, fixed): ``repairs`` with the word as it was read."""
    spark = documents.sparkSession
    scans = spread(documents.select("doc_id", "ocr_text").filter("ocr_text IS NOT NULL AND trim(ocr_text) <> ''"))
    furnished = _counted(scans)
    top = furnished.limit(most_shapes + 1).collect()
    sent = [] if len(top) > most_shapes else top
    shapes = spark.sparkContext.broadcast((frozenset(r.shape for r in sent if not r.near), frozenset(r.shape for r in sent if r.near)))
    if len(top) > most_shapes:
        scans = _own_shapes(scans, furnished)
    vocab = cut(vocabulary(documents))
    wrong = cut(misreadings(vocab))
    sound = vocab.join(wrong, "word", "left_anti").orderBy(F.desc("n"), "word").limit(SOUND_WORDS)
    fine = spark.sparkContext.broadcast(frozenset(r.word for r in sound.select("word").collect()))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            own = zip(b["shapes"], b["near"]) if "shapes" in b else [shapes.value] * len(b)
            for doc, text, (some, near) in zip(b["doc_id"], b["ocr_text"], own):
                lines, off, divided = body(text, frozenset(() if some is None else some), frozenset(() if near is None else near))
                rows += [(doc, k + 1, "furniture", "", "", False) for k in sorted(off)]
                skip = set()
                for k, n, first, second in divided:
                    rows.append((doc, k + 1, "hyphen", first, second, False))
                    skip |= {(k, "last"), (n, "first")}
                begin = True
                for k, x in enumerate(lines):
                    if k in off:
                        continue
                    if not x.strip():
                        begin = True
                        continue
                    if x[:1].isspace():
                        begin = True
                    tokens = x.split()
                    for i, raw in enumerate(tokens):
                        word = raw.strip(EDGES)
                        starts, begin = begin, raw[-1:] in ".?"
                        if not word or (i == 0 and (k, "first") in skip) or (i == len(tokens) - 1 and (k, "last") in skip):
                            continue
                        if (fixed := number(word)) is not None:
                            rows.append((doc, k + 1, "misread", fixed, word, False))
                        elif word not in fine.value and word.isascii():
                            rows.append((doc, k + 1, "word", word, "", starts))
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "kind", "a", "b", "starts"])

    found = cut(scans.mapInPandas(read, "doc_id bigint, line_no int, kind string, a string, b string, starts boolean"))
    done = found.filter("kind IN ('furniture', 'misread')").select("doc_id", "line_no", "kind", F.col("b").alias("typed"), F.col("a").alias("fixed"))
    words = (
        found.filter("kind = 'word'")
        .join(wrong.withColumnRenamed("word", "a"), "a")
        .select("doc_id", "line_no", F.lit("misread").alias("kind"), F.col("a").alias("typed"), F.when(F.col("starts"), F.coalesce("capital", "fixed")).otherwise(F.coalesce("small", "fixed")).alias("fixed"))
    )
    count = vocab.withColumnRenamed("word", "w")
    halves = found.filter("kind = 'hyphen'").select("doc_id", "line_no", F.concat("a", "b").alias("joined"), F.concat_ws("-", "a", "b").alias("dashed"))
    ways = halves.select("joined", "dashed").distinct()
    ways = ways.join(count.select(F.col("w").alias("joined"), F.col("n").alias("n_joined")), "joined", "left")
    ways = ways.join(count.select(F.col("w").alias("dashed"), F.col("n").alias("n_dashed")), "dashed", "left")
    fix = wrong.select(F.col("word").alias("joined"), F.col("fixed").alias("right"))
    ways = ways.join(fix, "joined", "left").select(
        "joined", "dashed", F.when(F.coalesce("n_dashed", F.lit(0)) > F.coalesce("n_joined", F.lit(0)), F.col("dashed")).otherwise(F.coalesce("right", "joined")).alias("fixed")
    )
    divided = halves.join(ways, ["joined", "dashed"]).select("doc_id", "line_no", F.lit("hyphen").alias("kind"), F.col("joined").alias("typed"), "fixed")
    return done.unionByName(words).unionByName(divided)
