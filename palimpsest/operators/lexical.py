"""Best matches of many queries in one block of records by the number of tokens they share.

Few tokens ("the", a template's words) make nearly all the pairs that share one, and they say little: queries and records
fall into few sets of them. Those sets are held against each other, once for all that have them; only what shares one of the
other tokens is looked at pair by pair. A record whose other tokens don't meet the query has its true score already; for any
other that score is too low, and the true one is among the pairs. So the first k by both together are the first k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palimpsest.functions import vocabulary as V

#: Numbers of tokens that may be held against each other as sets; pairs, or cells of sets, in memory at once.
COMMON, AT_ONCE = (0, 16, 32, 64, 128, 256), 1 << 21
#: What a cell of sets costs, in pairs.
CELL = 0.5


def rank_key(shared: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Overlap to nine digits, then the number shared, in one number; 0 for nothing shared."""
    over = shared / np.maximum(least, 1) * np.where(shared == 1, V.SINGLE_TERM, 1.0)
    return (np.floor(over * 1e9 + 0.5).astype(np.int64) << 32) | shared.astype(np.int64)


def _sets(row: np.ndarray, token: np.ndarray, place: np.ndarray, common: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each row has each of the first `common` tokens, with its size: distinct sets, their sizes, and each row's set."""
    has = np.zeros((len(size), common), np.uint8)
    ok = place[token] < common
    np.add.at(has, (row[ok], place[token[ok]]), 1)
    both = np.ascontiguousarray(np.concatenate([has, size.astype("<i4").view(np.uint8).reshape(-1, 4)], axis=1))
    _, first, of = np.unique(both.view(f"V{common + 4}").ravel(), return_index=True, return_inverse=True)
    return has[first].astype(np.float32), size[first], of


def _firsts(group: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their group; equal groups stand together."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)])) < k


def best(queries: pa.Array, nq: np.ndarray, records: pa.Array, nr: np.ndarray, k: int, common: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, record, shared): the first k records of each query, of those equal the ones that stand first. queries and
    records are lists of tokens, nq and nr their sizes. common: how many tokens are held against each other as sets; None: what costs least."""
    words = queries.flatten().dictionary_encode()
    qt, q_row = words.indices.to_numpy(), np.repeat(np.arange(len(nq)), pc.list_value_length(queries).to_numpy())
    found = pc.index_in(records.flatten(), value_set=words.dictionary)
    ok = found.is_valid().to_numpy(zero_copy_only=False)
    rt, r_row = found.drop_null().to_numpy(), np.repeat(np.arange(len(nr)), pc.list_value_length(records).to_numpy())[ok]
    n = len(words.dictionary)
    dq, dr = np.bincount(qt, minlength=n), np.bincount(rt, minlength=n)
    pairs = dq * dr
    order = np.argsort(-pairs, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    top = int(nq.max(initial=1))
    low = np.minimum(nr, top)  # more tokens than any query has count as so many
    choice = None
    for c in COMMON if common is None else (common,):
        c = min(c, n)
        if choice and choice[0] <= 0:
            break
        left = int(pairs[order[c:]].sum())
        if choice and c == choice[1]:
            break
        g, s = _sets(q_row, qt, place, c, nq), _sets(r_row, rt, place, c, low)
        cost = left + CELL * len(g[1]) * len(s[1])
        if choice is None or cost < choice[0]:
            choice = (cost, c, g, s)
        elif CELL * len(g[1]) * len(s[1]) > choice[0]:
            break  # more tokens make more sets
    _, common, (q_sets, q_size, q_of), (r_sets, r_size, r_of) = choice
    by_set = np.argsort(r_of, kind="stable")
    stands = by_set[_firsts(r_of[by_set], k)]  # of records of one set the first k
    at = np.searchsorted(r_of[stands], np.arange(len(r_size) + 1))
    rare_r = place[rt] >= common
    by_token = np.argsort(rt[rare_r], kind="stable")
    listed = r_row[rare_r][by_token]
    start = np.searchsorted(rt[rare_r][by_token], np.arange(n + 1))
    rare_q = (place[qt] >= common) & (dr[qt] > 0)
    q_tok, q_at = qt[rare_q], q_row[rare_q]
    by_group = np.argsort(q_of, kind="stable")
    bounds = np.searchsorted(q_of[by_group], np.arange(len(q_size) + 1))
    mine = np.searchsorted(q_at, np.arange(len(nq) + 1))  # q_at rises
    much = np.r_[0, np.cumsum(dr[q_tok])]
    step = max(1, AT_ONCE // max(1, len(r_size)))
    for g0 in range(0, len(q_size), step):
        g1 = min(len(q_size), g0 + step)
        shared = np.rint(q_sets[g0:g1] @ r_sets.T).astype(np.int32)
        keys = rank_key(shared, np.minimum(q_size[g0:g1, None], r_size[None, :]))
        keys[shared == 0] = 0
        firsts, bar = [], np.zeros(g1 - g0, np.int64)
        for j, key in enumerate(keys):
            least = max(1, int(np.partition(key, len(key) - k)[len(key) - k])) if len(key) > k else 1
            own = np.flatnonzero(key >= least)
            rec = np.concatenate([stands[at[s] : at[s + 1]] for s in own]) if 0 < len(own) < 64 else stands[(key >= least)[r_of[stands]]]
            each = key[r_of[rec]]
            if len(each) > k:
                chosen = np.lexsort((rec, -each))[:k]
                each, rec = each[chosen], rec[chosen]
                bar[j] = each[-1]
            elif len(each) == k:
                bar[j] = each.min()
            firsts.append((rec, each))
        who = by_group[bounds[g0] : bounds[g1]]
        weight = np.cumsum(much[mine[who + 1]] - much[mine[who]] + 8 * k)
        for part in np.split(who, np.flatnonzero(np.diff(weight // AT_ONCE)) + 1):
            if not len(part):
                continue
            got = [firsts[g - g0] for g in q_of[part]]
            many = np.array([len(x[0]) for x in got])
            q, rec, key = np.repeat(part, many), np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            n_tok = mine[part + 1] - mine[part]
            t = np.repeat(mine[part] - (np.cumsum(n_tok) - n_tok), n_tok) + np.arange(n_tok.sum())
            size = dr[q_tok[t]]
            to = listed[np.repeat(start[q_tok[t]] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            met, times = np.unique(np.repeat(q_at[t], size) * len(nr) + to, return_counts=True)
            a, b = np.divmod(met, max(1, len(nr)))
            true = rank_key(times + shared[q_of[a] - g0, r_of[b]], np.minimum(nq[a], nr[b]))
            good = true >= bar[q_of[a] - g0]
            q, rec, key = np.concatenate([q, a[good]]), np.concatenate([rec, b[good]]), np.concatenate([key, true[good]])
            o = np.lexsort((-key, rec, q))
            q, rec, key = q[o], rec[o], key[o]
            once = np.r_[True, (q[1:] != q[:-1]) | (rec[1:] != rec[:-1])] if len(q) else np.zeros(0, bool)
            q, rec, key = q[once], rec[once], key[once]
            o = np.lexsort((rec, -key, q))
            o = o[_firsts(q[o], k)]
            yield q[o], rec[o], key[o] & 0xFFFFFFFF


def in_block(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows(asks, query_id, id, t, n) of one block to (query_id, id, shared, least): n is a query's size, least the smaller one's."""

    def run(met: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(met)
        asked, held = rows.filter(rows["asks"]), rows.filter(pc.invert(rows["asks"]))
        held = held.take(pc.sort_indices(held["id"]))
        one = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
        query, record, asks, has = one(asked["query_id"]), one(held["id"]), one(asked["t"]), one(held["t"])
        nq, nr = one(asked["n"]).to_numpy().astype(np.int64), pc.list_value_length(has).to_numpy().astype(np.int64)
        del rows, asked, held
        for a, b, shared in best(asks, nq, has, nr, k):
            for at in range(0, len(a), 65536):
                i, j = a[at : at + 65536], b[at : at + 65536]
                yield pa.RecordBatch.from_arrays([query.take(pa.array(i)), record.take(pa.array(j)), pa.array(shared[at : at + 65536]), pa.array(np.minimum(nq[i], nr[j]))], names=["query_id", "id", "shared", "least"])

    return run
