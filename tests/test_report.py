from siftlog import LogicalQuery, Step, Term, step_report
from siftlog.plans.report import FAILED

VEHICLE = "sim_0015"
WINDOW = {"after": "2025-11-08 13:59:30", "before": "2025-11-08 14:00:30",
          "timestamp_regex": r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}"}
STEPS = [
    Step.of("enters traffic loop", must=["traffic#beforeDoPreOccupy", VEHICLE]),
    Step.of("locks points", must=["traffic#lockPoint", VEHICLE], failed=FAILED),
    Step.of("errors", any=["traffic#doingLockError", "LockFailedReason.DEADLOCK"]),
    Step.of("releases", must=["traffic#unlockRequestPoints", VEHICLE]),
]


def report(spark, lines):
    rows = [(f, n, n, c) for f, n, c in lines]
    entries = spark.createDataFrame(rows, "file_path string, start_line bigint, end_line bigint, content string")
    return [tuple(r) for r in step_report(entries, STEPS, WINDOW).orderBy("step_no").collect()]


def test_investigation(spark):
    pre, lock = f"traffic#beforeDoPreOccupy {VEHICLE}", f"traffic#lockPoint {VEHICLE}"
    long = "x" * 200
    lines = [
        ("b.log", 1, f"2025-11-08 14:00:00.000 {pre} {long}\n\t\n"),
        ("a.log", 9, f" \t2025-11-08 14:00:01.000 {pre} first{long}\n"),
        ("a.log", 1, f"2025-11-08 13:00:00.000 {pre} too early\n"),
        ("a.log", 11, f"2025-11-08 14:00:02.000 {lock} failedResult: []\n"),
        ("a.log", 12, f"2025-11-08 14:00:03.000 {lock} failedResult: DEADLOCK, OCCUPIED {long}\n"),
        ("a.log", 13, f"2025-11-08 14:00:04.000 {lock} failedResult: DEADLOCK\n"),
        ("a.log", 14, "2025-11-08 14:00:05.000 LockFailedReason.DEADLOCK\n"),
    ]
    got = report(spark, lines)
    first = lines[1][2].strip()[:100]
    failed = lines[4][2].strip()[:150]
    assert got == [
        (1, "enters traffic loop", 2, first, None, None),
        (2, "locks points", 3, lines[3][2].strip(), failed, "OCCUPIED"),
        (3, "errors", 1, lines[6][2].strip(), None, None),
        (4, "releases", 0, None, None, None),
    ]


def test_reason_of_the_first_failed_hit(spark):
    lock = f"2025-11-08 14:00:00.000 traffic#lockPoint {VEHICLE} failedResult"
    assert report(spark, [("a", 1, f"{lock} other"), ("a", 2, f"{lock} OCCUPIED")])[1][4:] == (f"{lock} other", None)
    assert report(spark, [("a", 2, f"{lock} OCCUPIED"), ("a", 1, f"{lock} DEADLOCK")])[1][4:] == (f"{lock} DEADLOCK", "DEADLOCK")
    assert report(spark, [])[1] == (2, "locks points", 0, None, None, None)


def test_own_conditions(spark):
    rows = [("a", 1, 1, "x bad"), ("a", 2, 2, "x good")]
    entries = spark.createDataFrame(rows, "file_path string, start_line bigint, end_line bigint, content string")
    steps = [Step.of("x", must=["x"], failed=LogicalQuery(must=[Term("bad")]))]
    assert [tuple(r) for r in step_report(entries, steps, reasons=("bad",)).collect()] == [(1, "x", 2, "x bad", "x bad", "bad")]
