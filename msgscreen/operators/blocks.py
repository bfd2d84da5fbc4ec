"""Top-k of a block of scores, for use inside Arrow tasks.

Scores are rounded to 6 digits and ties go to the lower id, exactly as in the final
ranking, so a task may drop whatever lies behind its own first k.
"""

from __future__ import annotations


#: Columns whose k-th score bounds that of all, and how many times k rows of a line may be sorted instead of selected.
SAMPLED = 2048
FEW = 64


def best_k(k: int):
    """``best(ids, scores[, floor])`` -> rows, ids, scores of the first k per row.

    ``floor`` gives, per row, a score that k earlier candidates already reached.
    Entries of minus infinity never qualify.
    """

    def best(ids, scores, floor=None):
        import numpy as np

        lower = floor
        if scores.shape[1] >= max(4 * SAMPLED, 4 * k):
            some = scores[:, :: scores.shape[1] // max(SAMPLED, k)]  # its k-th score is reached by k of all, too
            sampled = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k]
            lower = sampled if floor is None else np.maximum(sampled, floor)
        if lower is not None and np.isfinite(lower).all():
            above = scores >= (lower - 2e-6)[:, None]
            if np.count_nonzero(above) <= FEW * k * len(scores):  # little to sort, so the k-th need not be known
                rows, cols = np.nonzero(above)
                return first_k(ids, scores, *(c[np.isfinite(scores[rows, cols])] for c in (rows, cols)))
        if scores.shape[1] > k:
            kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        else:
            kth = np.full(len(scores), -np.inf)
        if floor is not None:
            kth = np.maximum(kth, floor)
        # The margin keeps everything that could round up to the k-th score.
        return first_k(ids, scores, *np.nonzero((scores >= (kth - 2e-6)[:, None]) & np.isfinite(scores)))

    def first_k(ids, scores, rows, cols):
        import numpy as np

        rounded = np.round(scores[rows, cols], 6)
        order = np.lexsort((ids[cols], -rounded, rows))
        rows, cols, rounded = rows[order], cols[order], rounded[order]
        first = np.searchsorted(rows, rows, side="left")
        top = (np.arange(len(rows)) - first) < k
        return rows[top], ids[cols[top]], rounded[top]

    return best


def running_best(k: int):
    """Per-task state: the first k per query over all blocks seen so far.

    Memory is queries * k, whatever the number of blocks.
    """
    best = best_k(k)

    def collect(query_ids, floor=None):
        """``floor``: scores known to be reached by k rows of each query elsewhere; what lies below is dropped."""
        import numpy as np
        import pyarrow as pa

        n = len(query_ids)
        known = np.full(n, -np.inf) if floor is None else floor
        ids = np.full((n, k), np.iinfo("int64").max, dtype="int64")
        scores = np.full((n, k), -np.inf)

        def add(at, block_ids, block_scores):
            """``at``: the first of consecutive queries, or the numbers of those that the rows of scores belong to."""
            lines = np.arange(at, at + len(block_scores)) if np.ndim(at) == 0 else at
            rows, new_ids, new_scores = best(block_ids, block_scores, np.maximum(scores[lines, -1], known[lines]))
            touched = np.unique(rows)
            if not len(touched):
                return
            at = lines[touched]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
            line = np.searchsorted(touched, rows)
            wide_ids = np.full((len(touched), 2 * k), np.iinfo("int64").max, dtype="int64")
            wide = np.full((len(touched), 2 * k), -np.inf)
            wide_ids[:, :k], wide[:, :k] = ids[at], scores[at]
            wide_ids[line, k + place], wide[line, k + place] = new_ids, new_scores
            order = np.lexsort((wide_ids, -wide), axis=1)[:, :k]
            ids[at] = np.take_along_axis(wide_ids, order, axis=1)
            scores[at] = np.take_along_axis(wide, order, axis=1)

        def results():
            rows, cols = np.nonzero(np.isfinite(scores))
            for at in range(0, len(rows), 1 << 16):
                r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
                yield pa.record_batch(
                    [pa.array(query_ids[r]), pa.array(ids[r, c]), pa.array(scores[r, c])],
                    names=["query_id", "doc_id", "score"],
                )

        return add, results

    return collect
