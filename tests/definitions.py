"""What operators mean, in the plainest form, for tests."""

from itertools import combinations


def states_by_definition(p, hi, lo, k, m):
    """Off until k values side by side reach hi, then on from the first of them until m values side by side lie below lo."""
    out, on = [], False
    while True:
        width = m if on else k
        here = [v < lo if on else v >= hi for v in p]
        found = next((i for i in range(len(out), len(p) - width + 1) if all(here[i : i + width])), None)
        if found is None:
            return out + [int(on)] * (len(p) - len(out))
        out += [int(on)] * (found - len(out)) + [int(not on)] * width
        on = not on


def dropped_by_definition(intervals):
    """intervals: sorted (start, stop, label). Every pair in order: of two that overlap, differ in label and are both still
    there, the shorter goes, of equal ones the earlier."""
    gone = set()
    for i, j in combinations(range(len(intervals)), 2):
        (a, b, x), (c, d, y) = intervals[i], intervals[j]
        if c < b and x != y and not gone & {i, j}:
            gone.add(i if b - a <= d - c else j)
    return [i in gone for i in range(len(intervals))]
