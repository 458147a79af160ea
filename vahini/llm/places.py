"""Problem 2: free-entered places mapped to a reference list by token-level repair and soft TF-IDF.

A row is read without any shuffle: the reference vocabulary (every spelling of every entry) goes out as a
symmetric-delete index behind a check of its size; each distinct token is repaired once per worker and then remembered.
Beyond the size, distinct tokens are repaired in a join on delete keys and come back to the rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahini.llm.latin import deletes, fold, osa, romanise
from vahini.session import cut, spread

#: Reference entries that may be sent to every worker (about 100 bytes and 60 delete keys each).
MOST_ENTRIES = 50_000

# What announces a district, a taluka or a village in an address, and words that are no names.
DISTRICT_CUES = frozenset("dist district di dt jilha zilla जि जिल्हा".split())
TALUKA_CUES = frozenset("tal taluka ta tq tehsil tahsil block ता तालुका तहसील".split())
VILLAGE_CUES = frozenset("at post a/p mouje mauje village vill mu मु मौजे गाव पो".split())
NOISE = frozenset("bk kh budruk khurd bu ms m s and nearby near other state the of बु खु बुद्रुक खुर्द व".split())
_WORD = re.compile(r"a/p|[^\W_]+(?:[̀-ͯऀ-ॿ]+[^\W_]*)*\.*", re.IGNORECASE)


class Reference:
    """The vocabulary: folded spelling -> [(kind, name id)], with delete keys; entries by name and district."""

    def __init__(self, rows: list[tuple], idf: dict[int, tuple[float, float]] | None = None):
        """``idf``: per place_id that of the taluka's and of the district's name, where the rows are only a part of the list."""
        self.spell: dict[str, set[tuple[str, int]]] = defaultdict(set)
        self.codes: dict[str, int] = {}
        self.district_entry: dict[int, int] = {}
        self.taluka_entry: dict[tuple[int, int], int] = {}
        ids: dict[tuple[str, str], int] = {}
        for place_id, district, taluka, code, former, name_mr in sorted(rows, key=lambda r: (r[2] is not None, r[0])):
            d = ids.setdefault(("d", fold(district or "")), len(ids))
            if taluka is None:
                self.district_entry[d] = place_id
                names = [n for n in (district, former, name_mr) if n]
                kind, name = "d", d
                if code:
                    self.codes[code.lower()] = d
            else:
                name = ids.setdefault(("t", fold(taluka)), len(ids))
                self.taluka_entry.setdefault((name, d), place_id)
                names, kind = [n for n in (taluka, name_mr) if n], "t"
            for n in names:
                self.spell[fold(n)].add((kind, name))
        self.districts_of: dict[int, list[int]] = defaultdict(list)
        for name, d in self.taluka_entry:
            self.districts_of[name].append(d)
        self.keys: dict[str, list[str]] = defaultdict(list)
        for s in self.spell:
            for k in deletes(s, 2 if len(s) >= 7 else 1):
                self.keys[k].append(s)
        entries = max(1, len(self.district_entry) + len(self.taluka_entry))
        count: dict[tuple[str, int], int] = defaultdict(int)
        for (name, d) in self.taluka_entry:
            count[("t", name)] += 1
            count[("d", d)] += 1
        self.idf = {k: math.log(1 + entries / n) for k, n in count.items()}
        if idf is not None:
            for (name, d), place_id in self.taluka_entry.items():
                self.idf["t", name], self.idf["d", d] = idf[place_id]
        self.sorted = sorted(self.spell)
        self.slots: dict[tuple[str, str], list] = {}
        self.memo: dict[str, list[tuple[str, int, float]]] = {}

    def repair(self, word: str) -> list[tuple[str, int, float]]:
        """(kind, name id, similarity) for a token: whole names within small edits; a prefix with a full stop."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[word] = self._repair(word)
        return got

    def _repair(self, word: str) -> list[tuple[str, int, float]]:
        s = fold(word)
        if len(s) == 3 and s in self.codes:
            return [("d", self.codes[s], 1.0)]
        if word.strip(".").lower() in self.codes:
            return [("d", self.codes[word.strip(".").lower()], 1.0)]
        if len(s) < 3:
            return []
        best: dict[tuple[str, int], float] = {}
        if s in self.spell:
            return [(k, n, 1.0) for k, n in sorted(self.spell[s])]
        if len(s) >= 5:
            most = 2 if len(s) >= 7 else 1
            for key in deletes(s, most):
                for other in self.keys.get(key, ()):
                    if (e := osa(s, other, most)) <= most:
                        for kn in self.spell[other]:
                            best[kn] = max(best.get(kn, 0.0), 1 - e / max(len(s), len(other)))
        if not best and word.endswith(".") and len(s) >= 3:
            for other in self.sorted[bisect_left(self.sorted, s) : bisect_left(self.sorted, s + "\uffff")]:
                if len(other) > len(s):
                    for kn in self.spell[other]:
                        best[kn] = 0.75
        top = max(best.values(), default=0)
        return [(k, n, v) for (k, n), v in sorted(best.items()) if v == top]

    def place(self, location: str | None, district: str | None, taluka: str | None) -> int:
        """The entry that the three fields name together, 0 if none."""
        slots = [*self._read(district, "d"), *self._read(taluka, "t"), *self._slots(location, "")]
        return self._rank(slots)

    def _read(self, text: str | None, default: str) -> list:
        """``_slots`` of a short field, whose texts come again."""
        got = self.slots.get((default, text))
        if got is None:
            if len(self.slots) > 100_000:
                self.slots.clear()
            got = self.slots[default, text] = list(self._slots(text, default))
        return got

    def _slots(self, text: str | None, default: str) -> Iterator[list[tuple[str, int, float]]]:
        if not text or not text.strip():
            return
        words = _WORD.findall(romanise_cues(text))
        role, skip, i = default, False, 0
        while i < len(words):
            plain = words[i].rstrip(".").lower()
            if plain in DISTRICT_CUES:
                role, skip = "d", False
            elif plain in TALUKA_CUES:
                role, skip = "t", False
            elif plain in VILLAGE_CUES:
                role, skip = "", True
            elif plain in NOISE or plain.isdigit():
                pass
            elif skip:
                skip = False
            else:
                found = self._fit(words[i], role)
                nxt = words[i + 1] if i + 1 < len(words) else ""
                after = nxt.rstrip(".").lower()
                if nxt and (not found or found[0][2] < 1) and after not in DISTRICT_CUES | TALUKA_CUES | VILLAGE_CUES | NOISE and not after.isdigit():
                    joined = self._fit(words[i].rstrip(".") + nxt, role)
                    if joined and (not found or joined[0][2] > found[0][2]):
                        found, i = joined, i + 1
                if found:
                    yield found
                if role != "t":
                    role = default
            i += 1

    def _fit(self, word: str, role: str) -> list[tuple[str, int, float]]:
        got = self.repair(word)
        if role and not default_any(got, role):
            return [g for g in got if g[2] >= 0.9]
        return [g for g in got if not role or g[0] == role]

    def _rank(self, slots: list[list[tuple[str, int, float]]]) -> int:
        """Soft TF-IDF over entries: a slot adds idf times similarity to every entry that holds one of its names."""
        sure = {n for s in slots for k, n, _ in s if k == "d" and len({m for kk, m, _ in s if kk == "d"}) == 1 and all(kk == "d" for kk, _, _ in s)}
        open_d = {n for s in slots for k, n, _ in s if k == "d"}
        score: dict[tuple[int, int], float] = defaultdict(float)
        hit: dict[tuple[int, int], set[int]] = defaultdict(set)
        support: dict[int, float] = defaultdict(float)
        for i, s in enumerate(slots):
            for k, n, v in s:
                if k == "d":
                    support[n] = max(support[n], v * self.idf.get((k, n), 1.0))
        for i, s in enumerate(slots):
            for k, n, v in s:
                if k == "t":
                    for d in self.districts_of[n]:
                        score[(n, d)] = max(score[(n, d)], v * self.idf.get((k, n), 1.0))
                        hit[(n, d)].add(i)
        ranked = {e: v + support.get(e[1], 0.0) for e, v in score.items()}
        if sure:
            inside = {e: v for e, v in ranked.items() if e[1] in sure}
        else:
            inside = {e: v for e, v in ranked.items() if e[1] in open_d} or ranked
        # Of the names one slot may stand for, the best-ranked entry counts.
        chosen: set[tuple[int, int]] = set()
        unclear = False
        for i in range(len(slots)):
            mine = sorted(((v, e) for e, v in inside.items() if i in hit[e]), reverse=True)
            if mine and (len(mine) == 1 or mine[0][0] > mine[1][0] + 1e-9):
                chosen.add(mine[0][1])
            elif mine:
                shared = [e for _, e in mine if len(hit[e]) > 1]
                if len(shared) == 1:
                    chosen.add(shared[0])
                else:
                    unclear = True
        if len(chosen) == 1:
            return self.taluka_entry[next(iter(chosen))]
        places = {e[1] for e in chosen} if chosen else (sure or (open_d if len(open_d) == 1 else set()))
        if not chosen and not places and unclear:
            places = {e[1] for e in inside}
        if len(places) == 1:
            return self.district_entry.get(next(iter(places)), 0)
        best = max(places, key=lambda d: (support.get(d, 0.0), -d), default=None)
        return self.district_entry.get(best, 0) if best is not None and support.get(best, 0.0) > 0 else 0


def default_any(got: list[tuple[str, int, float]], role: str) -> bool:
    return any(g[0] == role for g in got)


def romanise_cues(text: str) -> str:
    """Latin letters throughout, Devanagari cues replaced by their Latin form."""
    text = re.sub(r"(?<![\w])(जिल्हा|जि)(?=[\s.\-:])", " dist ", text)
    text = re.sub(r"(?<![\w])(तालुका|ता)(?=[\s.\-:])", " tal ", text)
    text = re.sub(r"(?<![\w])(मौजे|मु)(?=[\s.\-:])", " at ", text)
    return romanise(text)


FIELDS = ["location_raw", "district", "taluka"]
COLUMNS = ["place_id", "district", "taluka", "code", "former_name", "name_mr"]


def map_places(rows: DataFrame, reference: DataFrame, key: str = "row_id", most: int = MOST_ENTRIES) -> DataFrame:
    """(key, place_id) for every row whose location_raw, district or taluka is neither NULL nor blank.

    ``place_id`` is 0 where no entry is named (fillers, places outside the list). Whole-row repeats count once; fields
    that are NULL or blank say nothing; an empty reference gives 0 everywhere. A list of more than ``most`` entries isn't
    sent out: rows then meet the entries that share a token with them in a join.
    """
    todo = rows.dropDuplicates([key]).select(key, *FIELDS).filter(" or ".join(f"trim({f}) <> ''" for f in FIELDS))
    entries = reference.select(*COLUMNS)
    got = entries.limit(most + 1).collect()
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, place_id bigint"
    if len(got) > most:
        return _by_join(todo, entries, key, schema)
    sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in got])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = Reference(sent.value)
        for b in batches:
            yield pd.DataFrame({key: b[key], "place_id": [ref.place(*v) for v in zip(b["location_raw"], b["district"], b["taluka"])]})

    return spread(todo).mapInPandas(read, schema)


def _token_keys(word: str) -> set[str]:
    """Keys under which a token finds the names that ``Reference.repair`` may take it for."""
    s = fold(word)
    out = {"c:" + s, "c:" + word.strip(".").lower()}
    if len(s) >= 3:
        out |= deletes(s, 2 if len(s) >= 7 else 1)
        if word.endswith("."):
            out.add("p:" + s)
    return out


def _name_keys(entry: tuple) -> set[str]:
    _, district, taluka, code, former, name_mr = entry
    out = {"c:" + code.lower()} if code and taluka is None else set()
    for n in (district, former, name_mr) if taluka is None else (taluka, name_mr):
        if n:
            s = fold(n)
            out |= deletes(s, 2 if len(s) >= 7 else 1) | {"p:" + s[:k] for k in range(3, len(s))}
    return out


def _tokens(*texts: str | None) -> set[str]:
    """Words of the fields and neighbouring words put together."""
    out: set[str] = set()
    for t in texts:
        words = _WORD.findall(romanise_cues(t)) if t else []
        out |= set(words) | {a.rstrip(".") + b for a, b in zip(words, words[1:])}
    return out


def _idf(entries: DataFrame) -> DataFrame:
    """(place_id, idf_t, idf_d) over the whole list: of the taluka's and of the district's name."""

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"place_id": b["place_id"], "d": [fold(x or "") for x in b["district"]], "t": [None if x is None or x != x else fold(x) for x in b["taluka"]]})

    e = cut(entries.select("place_id", "district", "taluka").mapInPandas(folded, "place_id bigint, d string, t string"))
    talukas = e.filter("t IS NOT NULL").select("t", "d").distinct()
    n = talukas.count() + e.filter("t IS NULL").select("d").distinct().count()
    idf = lambda c: F.log(1 + F.lit(n) / F.coalesce(c, F.lit(n)))
    n_t, n_d = talukas.groupBy("t").agg(F.count("*").alias("n_t")), talukas.groupBy("d").agg(F.count("*").alias("n_d"))
    return e.join(n_t, "t", "left").join(n_d, "d", "left").select("place_id", idf("n_t").alias("idf_t"), idf("n_d").alias("idf_d"))


def _by_join(todo: DataFrame, entries: DataFrame, key: str, schema: str) -> DataFrame:
    """The same for a list of any length: distinct tokens join the names on delete keys, and each row is read with the
    entries that its tokens found (and their districts' own entries) as its reference."""

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, w) for k, *v in zip(b[key], *(b[f] for f in FIELDS)) for w in sorted(_tokens(*v))]
            yield pd.DataFrame(found, columns=[key, "token"])

    def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(w, k) for w in b["token"] for k in _token_keys(w)], columns=["token", "k"])

    def names_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [tuple(None if x is None or x != x else x for x in r) for r in b.itertuples(index=False)]
            yield pd.DataFrame([(r[0], k) for r in rows for k in _name_keys(r)], columns=["place_id", "k"])

    weights = _idf(entries)
    typed = cut(spread(todo).mapInPandas(words_of, schema.replace("place_id bigint", "token string")))
    near = spread(typed.select("token").distinct()).mapInPandas(keys_of, "token string, k string")
    near = near.join(spread(entries).mapInPandas(names_of, "place_id bigint, k string"), "k").select("token", "place_id").distinct()
    own = entries.filter("taluka IS NULL").select("district", F.struct(*COLUMNS).alias("own"))
    entry = F.struct(*COLUMNS, "idf_t", "idf_d")
    full = entries.join(weights, "place_id").join(own.withColumn("own", F.struct("own.*", F.lit(0.0).alias("idf_t"), F.lit(0.0).alias("idf_d"))), "district", "left")
    full = full.select("place_id", F.array_compact(F.array(entry, F.col("own"))).alias("es"))
    # The entries near the few tokens of one row are few.
    mine = typed.join(near, "token").select(key, "place_id").distinct().join(full, "place_id").groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("es"))).alias("es"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, es, *v in zip(b[key], b["es"], *(b[f] for f in FIELDS)):
                ref = Reference([tuple(e[c] for c in COLUMNS) for e in es], {e["place_id"]: (e["idf_t"], e["idf_d"]) for e in es}) if es is not None and len(es) else None
                out.append((k, ref.place(*v) if ref else 0))
            yield pd.DataFrame(out, columns=[key, "place_id"])

    return todo.join(mine, key, "left").mapInPandas(read, schema)
