"""What tasks do for triangles of large graphs, in whole arrays: pack edges, and solve teams of blocks.

Vertices have colours, a block holds the edges between two colours, and a team the
blocks of three. Whatever runs in a task is nested in ``packing`` or ``solving``, so it
travels by value and workers need not import this package.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Edges packed into one row, at most and about.
SLAB = 4_000_000
# Lookups made at once, and bytes that mark the lists they are made in.
LOOKUPS = 60_000
MARKS = 32_000_000


def packing(slab: int = SLAB):
    """Rows ``(x, y, one, two)`` to rows ``(x, y, edges)``, a block or part of one packed in each.

    A part holds its distinct ends once each, sorted, and from them on the second ends
    of every first one as gaps between places, a byte or two for most edges.
    """

    def ranked(ends):
        coded = ends.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        return coded.dictionary.take(order), rank[coded.indices.to_numpy()]

    def pack(one, two):
        (first, i), (second, j) = ranked(one), ranked(two)
        key = i * len(second) + j
        key.sort()
        i = key // len(second)
        j = key - i * len(second)
        gap = np.diff(j, prepend=0)
        heads = np.flatnonzero(np.diff(i, prepend=-1))
        gap[heads] = j[heads]
        gap = gap.astype(np.min_scalar_type(int(gap.max())))
        columns = [first, pa.array(np.bincount(i)), second, pa.array(gap)]
        row = pa.record_batch(
            [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns],
            ["first", "n", "second", "gap"],
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(row)
        return sink.getvalue()

    def packed(block, parts):
        edges = pack(*(pa.concat_arrays(ends) for ends in zip(*parts, strict=True)))
        x, y = block
        return pa.record_batch(
            [pa.array([x], pa.int32()), pa.array([y], pa.int32()), pa.array([edges.to_pybytes()], pa.binary())],
            ["x", "y", "edges"],
        )

    def run(batches):
        held, rows = {}, {}
        for batch in batches:
            x, y = batch["x"].to_numpy(), batch["y"].to_numpy()
            new = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
            for block in sorted(set(zip(x[new].tolist(), y[new].tolist(), strict=True))):
                mine = batch.filter(pa.array((x == block[0]) & (y == block[1])))
                held.setdefault(block, []).append((mine["one"], mine["two"]))
                rows[block] = rows.get(block, 0) + mine.num_rows
                if rows[block] >= slab:
                    yield packed(block, held.pop(block))
                    del rows[block]
        for block, parts in held.items():
            yield packed(block, parts)

    return run


def solving(corners: bool, lookups: int = LOOKUPS, marks: int = MARKS):
    """Blocks of teams to the triangles of each team: ``node`` and ``t`` of its corners, or their number ``t``.

    Rows ``(team, x, y, z, edges)`` of a team follow each other. A triangle of three
    colours is found from its edge between the first two, as a neighbour of the
    third that both ends have; one of two colours from its edge in a colour; one of a
    single colour from all three edges. Of the two lists of an edge the shorter one is
    looked up in the other, so the work has the bound of the sum over edges of the
    lower degree, hubs included.
    """

    def unpack(edges):
        row = pa.ipc.open_stream(edges).read_next_batch()
        first, n, second, gap = (row.column(c).values for c in range(4))
        n = n.to_numpy()
        gap = gap.to_numpy().astype(np.int64)
        at = np.cumsum(gap)
        heads = np.cumsum(n) - n
        at -= np.repeat(at[heads] - gap[heads], n)
        return first, np.repeat(np.arange(len(n)), n), second, at

    def lists(u, w, size_u, size_w):
        """Neighbours ``w`` of each ``u``: where its list begins, and all lists."""
        key = u * size_w + w
        key.sort()
        u = key // size_w
        key -= u * size_w
        begin = np.zeros(size_u + 1, np.int64)
        np.cumsum(np.bincount(u, minlength=size_u), out=begin[1:])
        return begin, key.astype(np.int32)

    def half(asked, other, there, here, size, t_asked, t_other, t_far):
        """Look up the lists ``here`` of ``other`` in the lists ``there`` of ``asked``, edge by edge."""
        if not len(asked):
            return 0
        wide = int(other.max()) + 1
        key = asked * wide + other
        key.sort()
        asked = key // wide
        other = key - asked * wide
        del key
        begin, near = here
        t_begin, t_near = there
        n = begin[other + 1] - begin[other]
        ahead = np.cumsum(n)
        # Marks take a row of bytes for each vertex asked; where rows are long and looked at
        # seldom, lists are searched.
        rows = max(1, marks // size)
        marked = int(ahead[-1]) * rows >= 20_000 * int(asked[-1] + 1 - asked[0])
        if marked:
            mark = np.zeros(min(rows, int(asked[-1] + 1 - asked[0])) * size, np.uint8)
        else:
            sorted_pairs = np.repeat(np.arange(len(t_begin) - 1) * size, np.diff(t_begin)) + t_near
        at, total = 0, 0
        while at < len(asked):
            done = int(ahead[at - 1]) if at else 0
            end = int(np.searchsorted(ahead, done + lookups))
            low = int(asked[at])
            if marked:
                end = min(end, int(np.searchsorted(asked, low + rows)))
            end = max(at + 1, end)
            u, v, length = asked[at:end], other[at:end], n[at:end]
            starts = ahead[at:end] - length - done
            place = np.repeat(begin[v] - starts, length)
            place += np.arange(len(place))
            w = near[place]
            if marked:
                high = int(u[-1]) + 1
                set_now = np.repeat(np.arange(high - low) * size, np.diff(t_begin[low : high + 1]))
                set_now += t_near[t_begin[low] : t_begin[high]]
                mark[set_now] = 1
                want = np.repeat((u - low) * size, length)
                want += w
                hit = mark[want]
                mark[set_now] = 0
            else:
                want = np.repeat(u * size, length)
                want += w
                found = np.minimum(np.searchsorted(sorted_pairs, want), len(sorted_pairs) - 1)
                hit = (sorted_pairs[found] == want).view(np.uint8)
            if corners:
                found = np.add.reduceat(hit, starts, dtype=np.int64)
                total += int(found.sum())
                np.add.at(t_asked, u, found)
                np.add.at(t_other, v, found)
                if t_far is not None:
                    far = w[hit.view(bool)]
                    if len(far) * 4 < size:
                        np.add.at(t_far, far, 1)
                    else:
                        t_far += np.bincount(far, minlength=size)
            else:
                total += int(np.count_nonzero(hit))
            at = end
        return total

    def common(u, v, of_u, of_v, size, t_u, t_v, t_far):
        """Common neighbours of both ends of each edge, added up, and at all corners."""
        in_u, in_v = np.diff(of_u[0])[u], np.diff(of_v[0])[v]
        some = np.minimum(in_u, in_v) > 0
        asked = some & (in_v <= in_u)
        total = half(u[asked], v[asked], of_u, of_v, size, t_u, t_v, t_far)
        asked = some & (in_v > in_u)
        return total + half(v[asked], u[asked], of_v, of_u, size, t_v, t_u, t_far)

    def solve(trio, held):
        p, q, r = trio
        if p == q == r:
            needed = [(p, p)]
        elif p == q or q == r:
            needed = [(q, q), (p, r)]
        else:
            needed = [(p, q), (p, r), (q, r)]
        if any(block not in held for block in needed):
            return 0, {}
        # Ends of a colour are numbered over all blocks of the team.
        parts = {block: [unpack(edges) for edges in held[block]] for block in needed}
        names, places = {}, {}
        for block, unpacked in parts.items():
            for k, (first, _, second, _) in enumerate(unpacked):
                for side, ends in enumerate((first, second)):
                    names.setdefault(block[side], []).append(ends)
                    places.setdefault(block[side], []).append((block, k, side))
        nodes, number = {}, {}
        for colour, all_ends in names.items():
            coded = pa.concat_arrays(all_ends).dictionary_encode()
            nodes[colour], done = coded.dictionary, 0
            codes = coded.indices.to_numpy().astype(np.int64)
            for place, ends in zip(places[colour], all_ends, strict=True):
                number[place] = codes[done : done + len(ends)]
                done += len(ends)
        ends = {}
        for block in needed:
            unpacked = parts.pop(block)
            ends[block] = tuple(
                np.concatenate([number[block, k, side][part[2 * side + 1]] for k, part in enumerate(unpacked)])
                for side in (0, 1)
            )
            del unpacked
        size = {colour: len(x) for colour, x in nodes.items()}
        t = {colour: np.zeros(n, np.int64) for colour, n in size.items()}
        if p == q == r:
            u, v = ends[p, p]
            near = lists(np.concatenate([u, v]), np.concatenate([v, u]), size[p], size[p])
            total = common(u, v, near, near, size[p], t[p], t[p], None) // 3
            t[p] //= 2
        elif p == q or q == r:
            far = r if p == q else p
            u, v = ends[q, q]
            side = 0 if p == q else 1
            near = lists(ends[p, r][side], ends[p, r][1 - side], size[q], size[far])
            total = common(u, v, near, near, size[far], t[q], t[q], t[far])
        else:
            of_p = lists(*ends.pop((p, r)), size[p], size[r])
            of_q = lists(*ends.pop((q, r)), size[q], size[r])
            total = common(*ends[p, q], of_p, of_q, size[r], t[p], t[q], t[r])
        return total, {colour: (nodes[colour], t[colour]) for colour in nodes}

    def result(trio, held):
        total, found = solve(trio, held)
        if not corners:
            yield pa.record_batch([pa.array([total], pa.int64())], ["t"])
            return
        for nodes, t in found.values():
            met = np.flatnonzero(t)
            yield pa.record_batch([nodes.take(pa.array(met)), pa.array(t[met])], ["node", "t"])

    def run(batches):
        team, trio, held = None, None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                of, x, y, z = (batch[c][k].as_py() for c in ("team", "x", "y", "z"))
                if of != team:
                    if held:
                        yield from result(trio, held)
                    team, trio, held = of, sorted((x, y, z)), {}
                held.setdefault((x, y), []).append(batch["edges"][k].as_buffer())
        if held:
            yield from result(trio, held)

    return run
