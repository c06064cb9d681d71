"""Polishing restores a known truth from perfect reads."""

import random

import pytest
from strandwise.functions.sequence import reverse_complement  # noqa: F401
from strandwise.plans import polish
from strandwise.plans.settings import Settings, option_value

SMALL = Settings(window=2000, overlap=400, stitch=50)


def truth(n=3000, seed=1):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def reads_of(seq, length, depth, seed=2):
    r = random.Random(seed)
    turn = str.maketrans("ACGT", "TGCA")
    out = []
    for i in range(len(seq) * depth // length):
        at = r.randrange(0, len(seq) - length + 1)
        s = seq[at : at + length]
        out.append((i, s if i % 2 else s.translate(turn)[::-1]))
    return out


def damaged(seq, seed=3, kinds="sid"):
    r = random.Random(seed)
    out = list(seq)
    for i in range(200, len(seq) - 200, 250):
        k = r.choice(kinds)
        if k == "s":
            out[i] = "ACGT"[("ACGT".index(out[i]) + 1) % 4]
        elif k == "i":
            out[i] += "ACGT"[("ACGT".index(out[i]) + 2) % 4]
        else:
            out[i] = ""
    return "".join(out)


def test_short_reads_restore_substitutions_and_indels(spark):
    t = truth()
    contigs = spark.createDataFrame([(7, damaged(t))], "tid bigint, seq string")
    short = spark.createDataFrame(reads_of(t, 150, 30), "tid bigint, seq string")
    got = polish.run(contigs, Settings(task="1", window=2000, overlap=400), short=short).collect()
    assert [r.tid for r in got] == [7]
    s = got[0].seq
    assert s.upper()[150:-150] == t[150:-150]
    assert s[300:-300].isupper()


def test_uncovered_stretch_stays_in_lower_case(spark):
    t = truth(2000)
    contigs = spark.createDataFrame([(1, t)], "tid bigint, seq string")
    rows = [(i, t[a : a + 150]) for i, a in enumerate([*range(0, 700, 10), *range(1200, 1850, 10)])]
    short = spark.createDataFrame(rows, "tid bigint, seq string")
    s = polish.run(contigs, Settings(task="1", window=5000, overlap=400), short=short).collect()[0].seq
    assert s.upper() == t
    assert s[900:1150].islower() and s[200:700].isupper() and s[1300:1800].isupper()


def test_haplotype_task_takes_the_most_frequent(spark):
    t = truth(1200, 5)
    masked = t[:600] + t[600:606].lower() + t[606:]
    other = t[:602] + ("A" if t[602] != "A" else "C") + t[603:]
    reads = [(i, (other if i % 4 == 0 else t)[a : a + 150]) for i, a in enumerate(range(470, 590, 4))]
    contigs = spark.createDataFrame([(1, masked)], "tid bigint, seq string")
    s = polish.run(contigs, Settings(task="2"), short=spark.createDataFrame(reads, "tid bigint, seq string")).collect()[0].seq
    assert s == t


def test_phase_task_replaces_and_keeps_one_haplotype(spark):
    t = truth(1500, 6)
    swap = lambda s, i: s[:i] + ("A" if s[i] != "A" else "C") + s[i + 1 :]
    one, two = t, swap(swap(t, 700), 760)
    wrong = swap(t, 400)
    reads = [(k, (one if k % 2 else two)[a : a + 150]) for k, a in enumerate(range(250, 1200, 5))]
    contigs = spark.createDataFrame([(1, wrong)], "tid bigint, seq string")
    s = polish.run(contigs, Settings(task="3"), short=spark.createDataFrame(reads, "tid bigint, seq string")).collect()[0].seq
    assert s[400] == t[400]
    u = s.upper()
    assert u[700] + u[760] in (one[700] + one[760], two[700] + two[760])
    assert s[700].islower() and s[760].islower()


@pytest.mark.parametrize("kind", ["ont", "hifi"])
def test_long_reads_restore(spark, kind):
    t = truth(4000, 9)
    contigs = spark.createDataFrame([(3, damaged(t, 4, "sd"))], "tid bigint, seq string")
    long = spark.createDataFrame(reads_of(t, 800, 20), "tid bigint, seq string")
    s = polish.run(contigs, Settings(task="5", read_type=kind, window=2500, overlap=500), long=long).collect()[0].seq
    assert s.upper()[400:-400] == t[400:-400] or s.upper().find(t[400:-400]) >= 0


def test_tasks_and_settings():
    s = Settings.parse("[General]\ntask = best  # all rounds\nwindow = 5M\nuppercase = yes\n; no\nread_type=hifi\n")
    assert (s.task, s.window, s.uppercase, s.read_type) == ("best", 5_000_000, True, "hifi")
    assert s.tasks(True, True) == [5, 5, 6, 6, 1, 2, 1, 2]
    assert s.tasks(True, False) == [1, 2, 1, 2]
    with pytest.raises(ValueError):
        Settings(task="125").tasks(True, True)
    with pytest.raises(ValueError):
        Settings(task="9").tasks(True, True)
    assert option_value("-x map-ont -t 5", "-t") == ("5", "-x map-ont")
    assert option_value("-x map-ont", "-t") == (None, "-x map-ont")
