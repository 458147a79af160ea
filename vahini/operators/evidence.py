"""Auditable evidence scores: named signs with weights; what counts as linked or suggested follows from the signs present."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vahini.operators.pairing import Classes, Words, among, blocks, codes, either_holds, holders, in_slices


@dataclass(frozen=True)
class Sign:
    name: str
    weight: float
    hit: Column
    strong: bool = True
    decisive: bool = False


def score_evidence(pairs: DataFrame, signs: list[Sign], needed: tuple[str, ...]) -> DataFrame:
    """Add reasons (names of the signs present, in the order given), score (sum of weights, at most 1) and link_status.

    "linked": a decisive sign, or all that are needed; "suggested": two strong signs; else "none". An unknown sign (NULL)
    is absent.
    """
    hit = lambda s: F.coalesce(s.hit, F.lit(False))
    reasons = F.array_compact(F.array(*[F.when(hit(s), F.lit(s.name)) for s in signs]))
    score = F.least(F.lit(1.0), F.round(sum((F.when(hit(s), s.weight).otherwise(0.0) for s in signs), F.lit(0.0)), 4))
    by = {s.name: s for s in signs}
    decisive = [hit(s) for s in signs if s.decisive]
    everything = F.lit(True)
    for n in needed:
        everything = everything & hit(by[n])
    sure = everything
    for d in decisive:
        sure = sure | d
    strong = sum((F.when(hit(s), 1).otherwise(0) for s in signs if s.strong), F.lit(0))
    status = F.when(sure, "linked").when(strong >= 2, "suggested").otherwise("none")
    return pairs.withColumns({"reasons": reasons, "score": score, "link_status": status})


REFERENCE, TOWN, AGENCY, DISTRICT, COMPONENT, SCHEME, MARKED = (1 << i for i in range(7))
#: How many strong signs are among the bits.
STRONG_SIGNS = np.array([sum((x & bit) > 0 for bit in (TOWN, AGENCY, COMPONENT, SCHEME)) for x in range(256)], np.uint8)
LINKS = "project_ids array<string>, row_ids array<bigint>, signs int"


def district_links(projects: DataFrame, tenders: DataFrame, counted: tuple[DataFrame, DataFrame] | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """(project_ids, row_ids, signs) for pairs of one ``district`` that have a reference or two strong signs; ``signs`` as bits.

    projects(project_id, district, town, code, order_key, scheme, words, marked), tenders(row_id, district, title, digits,
    plain, funding, agency, words), texts prepared for comparison. A row has each project with each tender listed, as many
    pairs have the same signs: the pairs are by far more than the rows. Each pair comes once. ``marked`` projects carry the
    bit MARKED. ``counted`` has the districts of both sides, for the slices; ``prepare`` makes the columns of the tenders that
    have a project in their district.
    """
    return in_slices(projects, tenders, "district", "row_id", _links, LINKS, counted=counted, prepare=prepare)


def _links(p: pa.Table, t: pa.Table) -> pa.Table:
    """Projects of one scheme and set of words meet tenders of one funding, agency and set of words as classes. Towns and
    references are of single pairs, which are taken out of their classes."""
    ids, row_ids = p["project_id"].combine_chunks(), t["row_id"].combine_chunks()
    out = [_listed(ids, row_ids, *[np.zeros(0, np.int64)] * 5)]
    if not len(p) or not len(t):
        return out[0]
    said = {c: p[c].to_pylist() for c in ("town", "code", "order_key")} | {c: t[c].to_pylist() for c in ("title", "digits", "plain")}
    sparse = [(TOWN, *either_holds(said["town"], said["title"])), (REFERENCE, *holders(said["code"], said["digits"]))]
    sparse.append((REFERENCE, *holders([k if k and len(k) >= 8 else None for k in said["order_key"]], said["plain"])))
    single, at = np.unique(np.concatenate([i * len(t) + j for _, i, j in sparse]), return_inverse=True)
    bits = np.zeros(len(single), np.int64)
    np.bitwise_or.at(bits, at.ravel(), np.repeat([bit for bit, _, _ in sparse], [len(i) for _, i, _ in sparse]))
    i, j = np.divmod(single, len(t))

    (own, of), (paid, by) = codes(p["scheme"]), codes(t["funding"])
    schemes = np.zeros((len(own), len(paid)), np.int64)
    schemes[either_holds(own, paid)] = SCHEME
    agency = pc.fill_null(t["agency"], False).to_numpy().astype(np.int64) * AGENCY
    marked = pc.fill_null(p["marked"], False).to_numpy().astype(np.int64) * MARKED
    words = Words(p["words"], t["words"])
    shared = words.share(2)

    known = schemes[of[i], by[j]] | agency[j] | np.where(shared[words.of[i], words.many_of[j]], COMPONENT, 0)
    linked = (STRONG_SIGNS[bits | known] >= 2) | ((bits & REFERENCE) > 0)
    out.append(_pairs(ids, row_ids, i[linked], j[linked], (bits | known | marked[i])[linked]))

    few, many = Classes(of, words.of, marked), Classes(by, words.many_of, agency)
    (scheme, said_by, mark), (funding, said_in, paid_by) = few.codes, many.codes
    touched, any_touched = np.unique(few.of[i] * len(t) + j), np.zeros(len(t), bool)
    any_touched[j] = True
    for begin, end in blocks(len(few.size), len(many.size)):
        here = slice(begin, end)
        signs = schemes.astype(np.uint8)[scheme][:, funding[here]] | (shared[said_by][:, said_in[here]] * np.uint8(COMPONENT)) | paid_by[here].astype(np.uint8)
        a, b = np.nonzero(STRONG_SIGNS[signs] >= 2)
        kind = (a << 8) | signs[a, b]
        order = np.argsort(kind, kind="stable")
        tender, n = many.members(b[order] + begin)
        kind = np.repeat(kind[order], n)
        maybe = np.flatnonzero(any_touched[tender])
        alone = maybe[among((kind[maybe] >> 8) * len(t) + tender[maybe], touched)]
        left = np.ones(len(tender), bool)
        left[alone] = False
        # Whole classes of projects with the tenders left to them.
        kinds, n_rows = np.unique(kind[left], return_counts=True)
        project, n_ids = few.members(kinds >> 8)
        out.append(_listed(ids, row_ids, project, n_ids, tender[left], n_rows, (kinds & 255) | mark[kinds >> 8]))
        # Tenders with a single pair in a class meet the others of the class.
        project, n = few.members(kind[alone] >> 8)
        tender, value = np.repeat(tender[alone], n), np.repeat((kind[alone] & 255) | mark[kind[alone] >> 8], n)
        others = ~among(project * len(t) + tender, single)
        out.append(_pairs(ids, row_ids, project[others], tender[others], value[others]))
    return pa.concat_tables(out).combine_chunks()



def _listed(ids: pa.Array, row_ids: pa.Array, project: np.ndarray, n_ids: np.ndarray, tender: np.ndarray, n_rows: np.ndarray, signs: np.ndarray) -> pa.Table:
    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), of.take(pa.array(at))) for of, at, n in ((ids, project, n_ids), (row_ids, tender, n_rows))]
    return pa.table({"project_ids": lists[0], "row_ids": lists[1], "signs": pa.array(signs | DISTRICT, pa.int32())})


def _pairs(ids: pa.Array, row_ids: pa.Array, project: np.ndarray, tender: np.ndarray, signs: np.ndarray) -> pa.Table:
    one = np.ones(len(signs), np.int64)
    return _listed(ids, row_ids, project, one, tender, one, signs)
