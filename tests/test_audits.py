"""Findings of an audit: verdicts, bounded severities, grounded evidence and a second look, by hand."""

from leafmill.operators import joins

VERDICTS = "requirement_id int, status string, severity string, confidence double, evidence string, grounded boolean, rationale string, seq long"


def test_verdicts_become_findings(spark):
    requirements = spark.createDataFrame([(i, d) for i, d in enumerate(["major", "critical", "info", "minor", "odd", "major", "major"])], "requirement_id int, severity_default string")
    rows = [
        (0, "Compliant", "Critical", 0.9, "a quote", True, "why", 1), (0, " partial ", "info", 1.4, "x" * 600, True, "r" * 700, 2), (1, "bogus", "minor", None, None, None, None, 1), (2, "compliant", None, -3.0, "made up", False, "why", 1),
        (3, None, "info", 0.3, "made up", None, "r" * 650, 5), (4, "not_applicable", "major", 0.5, "", True, "", 1), (99, "compliant", "major", 1.0, None, None, None, 1),
    ]
    got = {r.requirement_id: tuple(r)[1:] for r in joins.requirement_verdict_join(requirements, spark.createDataFrame(rows, VERDICTS)).collect()}
    assert got[0] == ("partial", "major", 1.0, "x" * 500, "r" * 600)  # info is two steps from major
    assert got[1] == ("non_compliant", "critical", 0.6, None, None)
    assert got[2] == ("compliant", "info", 0.0, None, "why" + joins.UNGROUNDED)
    assert got[3] == ("non_compliant", "info", 0.3, None, ("r" * 600 + joins.UNGROUNDED)[:700])
    assert got[4] == ("not_applicable", "odd", 0.5, None, None)
    assert got[5] == got[6] == ("not_applicable", "major", 0.0, None, joins.NOT_ASSESSED)
    assert joins.requirement_verdict_join(requirements.limit(0), spark.createDataFrame(rows, VERDICTS)).count() == 0


def test_a_second_look(spark):
    findings = spark.createDataFrame([(i, "non_compliant", 0.5, "why") for i in range(7)] + [(7, "non_compliant", None, None)], "finding_id int, status string, confidence double, rationale string")
    second = [(0, "compliant", True), (1, "compliant", False), (2, "partial", None), (3, "non_compliant", None), (4, "not_applicable", False), (5, "odd", True), (7, " Partial", True)]
    got = {r.finding_id: tuple(r)[1:] for r in joins.verdict_overturn(findings, spark.createDataFrame(second, "finding_id int, second string, grounded boolean")).collect()}
    same, noted = ("non_compliant", 0.5, "why"), "why" + joins.CORRECTED
    assert got == {
        0: ("compliant", 0.8, noted), 1: same, 2: same, 3: ("non_compliant", 0.85, "why"), 4: ("not_applicable", 0.8, noted), 5: ("non_compliant", 0.85, "why"), 6: same, 7: ("partial", 0.8, joins.CORRECTED.strip()),
    }


def test_a_digest_by_hand(spark):
    from leafmill.operators import audits

    schema = "run_id int, finding_id string, ord int, requirement_id int, section_no string, requirement_title string, dimension string, severity string, status string, confidence double, suggested_fix string"
    rows = [
        (1, "a", 1, 1, "2.1", "One", "content", "minor", "partial", 1.0, " Fix it "), (1, "b", 2, 1, "10.1", "Two", "style", "critical", "non_compliant", 1.0, None), (1, "c", 3, 1, None, "Three", "tone", "odd", "partial", 1.0, "x" * 200), (1, "d", 4, 1, "3", "Four", "tone", "major", "compliant", 1.0, None),
        (2, "a", 1, 1, "1", "One", "content", "minor", "compliant", 1.0, None),
    ]
    titles = spark.createDataFrame([("2", "Scope")], "section string, title string")
    got = {r.run_id: r.digest for r in audits.audit_digest(spark.createDataFrame(rows, schema), titles).collect()}
    assert got[1].split("\n") == [
        "Overall: 45% (failing). Severity counts: {'critical': 1, 'major': 0, 'minor': 1, 'info': 0}.", "Sections with issues: 2 Scope (1), 10  (1), —  (1)", "", "Top open findings (section | severity/dimension | requirement → fix):",
        "- [10.1] critical/style: Two", "- [2.1] minor/content: One → Fix it", "- [None] odd/tone: Three → " + "x" * 160,
    ]
    assert got[2] == "Overall: 100% (strong). Severity counts: {'critical': 0, 'major': 0, 'minor': 0, 'info': 0}."


def test_requirements_of_sections(spark):
    from leafmill.operators import audits

    rows = [(1, 1, "9.4", "Design", 1, "Intro - first item -  short - " + "y" * 241 + " • last\nitem here. Limited to 3 pages"), (1, 2, "10", None, 2, None), (1, 3, "11", "Well", 2, "a well-known thing of note - it is")]
    got = audits.requirement_extract(spark.createDataFrame(rows, "doc_id int, n int, section_no string, title string, level int, text string")).orderBy("n", "k").collect()
    assert [(r.n, r.k, r.kind, r.title) for r in got] == [
        (1, 0, "presence", "Include section: Design"), (1, 1, "constraint", "Limit Design length"), (1, 2, "content", "first item"), (1, 5, "content", "last item here. Limited to 3 pages"),
        (2, 0, "presence", "Include section: "), (3, 0, "presence", "Include section: Well"), (3, 2, "content", "known thing of note"),
    ]
    assert got[0].severity == "major" and got[4].severity == "minor" and got[1].constraint_spec == '{"type": "max_pages", "value": 3}'
    assert got[0].requirement_text == "The document must address section 9.4 — Design."
