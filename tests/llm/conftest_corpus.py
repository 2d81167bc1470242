import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Documents with exact and near copies, shared passages, nulls, blanks, repeated rows, a very long text."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    rows = [(k, prose(rng, rng.randint(1, 160)), "en", f"s{k % 3}", 1) for k in range(60)]
    rows += [(100 + k, prose(rng, 20) + " " + passage + " " + prose(rng, 15), "en", "s1", 1) for k in range(4)]
    rows += [(200, rows[7][1], "en", "s0", 1), (201, rows[7][1], "en", "s2", 1), (202, rows[7][1] + " more words here", "en", "s2", 1)]
    near = rows[11][1].split()
    rows += [(210 + k, " ".join([*near[:k], "changed", *near[k + 1 :]]), "en", "s1", 1) for k in range(min(5, len(near)))]
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, "  \n\t ", "en", "s0", 3), (303, "one", "en", None, 3), (304, "one", "en", "s1", 3)]
    rows += [(305, " ".join(["same"] * 130), "en", "s2", 1), (306, " ".join(["a b c"] * 60), "en", "s2", 1), (307, prose(rng, 12_000), "en", "s2", 1)]
    rows += [rows[3], rows[3], (None, rows[4][1], "en", "s1", 1)]
    return rows
