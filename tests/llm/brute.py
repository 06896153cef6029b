"""Plain versions of the operators, for small tables."""
import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def near(rows, width, num, den):
    """[(n_shingles, component)] of rows (key, text), by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    lows = collections.defaultdict(list)
    for (key, _), g in zip(rows, group):
        if key is not None:
            lows[g].append(key)
    return [(len(s), min(lows[g]) if lows[g] else None) for s, g in zip(sets, group)]


def covered(sequences, length):
    """Flags of the symbols under a window that occurs anywhere else."""
    count = collections.Counter(q[i:i + length] for q in sequences for i in range(len(q) - length + 1))
    out = []
    for q in sequences:
        flags = [False] * len(q)
        for i in range(len(q) - length + 1):
            if count[q[i:i + length]] > 1:
                flags[i:i + length] = [True] * length
        out.append(flags)
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def base_counts(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(repeated)
