from lodestream.llm.matching import match_records

SCHEMA = "record_id long, name string, email string, github_handle string, slack_handle string, slack_user_id string, linear_uuid string, linear_display_name string, team string, aliases array<string>, source string, score double, a long"


def run(spark, rows):
    full = [(i, n, e, g, s, "", "", d, "", al, src, 1.0, 1) for i, src, n, e, g, s, d, al in rows]
    return {(r["record_a"], r["record_b"]): r["confidence"] for r in match_records(spark.createDataFrame(full, SCHEMA)).collect()}


def test_people_across_sources(spark):
    rows = [
        (1, "static-csv", "Harold Sherkacak", "H_S@X.example", "hsherkacak", "hal.sherkacak", None, ["sherkacak542@post.example"]),
        (2, "slack-users", "Hal Sherkacak", "h_s@x.example ", None, "@hsherkacak", "", None),
        (3, "linear-users", "Sherkacak, Harold", "n/a", None, None, "sherkacak.h", None),
        (4, "github-org", "H. Sherkacak", "sherkacak542@post.example", "", "", "", None),
        (5, "github-org", "Viola Sherkacak", "noreply@codehub.example", "violasherkacak", "", "", None),
        (6, "slack-users", "Viola Sherkacak", "unknown@invalid", None, "Viola Sherkacak | data", "", None),
        (7, "linear-users", "Zachary Fegistist", "zachary_fegistist3124@n.example", None, None, "zachary", None),
        (8, "slack-users", "Zachary Fegistist", "zachary_fegistist976@n.example", None, "zachary", None, None),
        (9, "github-org", "Zachary F.", "", "zacharyfegistist3124", "", "", None),
        (10, "github-org", None, None, None, None, None, None),
        (None, "slack-users", "Harold Sherkacak", "h_s@x.example", None, None, None, None),
        (11, None, "Harold Sherkacak", "h_s@x.example", None, None, None, None),
        (12, "slack-users", "x" * 50_000, "", "", "", "", []),
    ]
    rows += [(100 + k, ("slack-users", "linear-users")[k % 2], f"Filler{chr(97 + k % 26)}{chr(97 + k // 26)}xx Other{chr(97 + k // 26)}{chr(97 + k % 26)}yy", f"q{k}w@z.example", "", "", "", None) for k in range(60)]
    got = run(spark, rows)
    small = {p for p in got if max(p) < 100}
    assert {(1, 2), (1, 3), (2, 3), (1, 4), (5, 6), (7, 9)} <= small
    assert not {(7, 8), (8, 9)} & small and not {p for p in small if (5 in p or 6 in p) and p != (5, 6)}
    assert all(0.5 <= c <= 1 for c in got.values())


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    row = (1, "static-csv", "Ann Quimboltak", "ann@x.example", "", "", "", None)
    assert run(spark, [row, row]) == {}
