"""The known cases of name repair, and hand-made cases for the other rules."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from gradeweave.plans.validate import (
    Rules,
    repair_dashes,
    repair_flipped,
    resolve_emphasis,
    resolve_standing,
    validate_scores,
)


def pairs(names, **extra):
    return [dict(zip(("first", "last", "id", "score"), n), **extra) for n in names]


def outcome(validation):
    rows = validation.scores.orderBy("ord").collect()
    return rows, sorted(r.message for r in validation.messages.collect())


ALISON = [("Alison", "Means", "Alison Means", 3), ("Alison", "Means", "Alison Means", 4)]

NAME_CASES = {
    "first name, one letter too many": (
        [("Allison", "Means", "Allison Means", 4), *ALISON], 1, [("Alison", "Means")] * 3),
    "last name, case and letter": (
        [("Eric", "Albrecht", "Eric Albrecht", 4), ("Eric", "ALbrecht", "Eric Albrecht", 3),
         ("Eric", "Albrecht", "Eric Albrecht", 4), ("Eric", "Albrect", "Eric Albrect", 4)],
        2, [("Eric", "Albrecht")] * 4),
    "different names": (
        [("Eric", "Snow", "Eric Snow", 4), ("Eric", "Snow", "Eric Snow", 3), ("Eric", "Wood", "Eric Wood", 4)],
        0, [("Eric", "Snow"), ("Eric", "Snow"), ("Eric", "Wood")]),
    "plural": (
        [("Eric", "Wood", "Eric Wood", 4), ("Eric", "Wood", "Eric Wood", 3), ("Eric", "Woods", "Eric Woods", 4)],
        1, [("Eric", "Wood")] * 3),
    "first name null": (
        [(None, "Means", "Allison Means", 4), *ALISON], 0, [(None, "Means")] + [("Alison", "Means")] * 2),
    "first name empty": (
        [("", "Means", "Allison Means", 4), *ALISON], 0, [("", "Means")] + [("Alison", "Means")] * 2),
    "last name null": (
        [("Alison", None, "Allison Means", 4), *ALISON], 0, [("Alison", None)] + [("Alison", "Means")] * 2),
    "last name empty": (
        [("Alison", "", "Allison Means", 4), *ALISON], 0, [("Alison", "")] + [("Alison", "Means")] * 2),
}


NAME_CASES["a letter without a capital"] = (
    [("Eric", "Strauß", "Eric Strauß", 4), ("Eric", "Strauss", "Eric Strauss", 3), ("Eric", "Strauss", "Eric Strauss", 4)],
    0, [("Eric", "Strauß"), ("Eric", "Strauss"), ("Eric", "Strauss")])
NAME_CASES["a letter without a capital, one edit apart"] = (
    [("Ilkın", "Snow", "Ilkın Snow", 4), ("Ilkin", "Snow", "Ilkin Snow", 3), ("Ilkin", "Snow", "Ilkin Snow", 4)],
    1, [("Ilkin", "Snow")] * 3)


@pytest.fixture(scope="module")
def repaired_cases(scores_of):
    """All cases at once: each is many small jobs, so they run side by side."""

    def repair(case):
        before = scores_of(pairs(NAME_CASES[case][0]))
        result = validate_scores(before)
        return case, (before.orderBy("ord").collect(), *outcome(result), result.messages.collect())

    with ThreadPoolExecutor(len(NAME_CASES)) as pool:
        return dict(pool.map(repair, NAME_CASES))


@pytest.mark.parametrize("case", NAME_CASES)
def test_name_cases(repaired_cases, case):
    _, n_messages, expected = NAME_CASES[case]
    before, rows, messages, _ = repaired_cases[case]
    assert len(messages) == n_messages
    assert [(r.first_name, r.last_name) for r in rows] == expected
    if not n_messages:
        assert rows == before


def test_message_text_and_keys(repaired_cases):
    (m,) = repaired_cases["plural"][3]
    assert m.message == (
        "Student Eric Wood has potential misspelled name Eric Woods in semester Spring 2019; using Eric Wood"
    )
    assert (m.kind, m.sort_value, m.sort_key) == ("misspelled", "Spring 2019_Eric Wood", "Wood2019_ERIC")


FLIP = pairs([("Eric", "Albrecht", "Eric Albrecht", 4)] * 3 + [("Albrecht", "Eric", "Albrecht Eric", 2)])


def test_flip_takes_identifier_but_leaves_names_flipped(scores_of):
    rows, messages = outcome(repair_flipped(scores_of(FLIP)))
    assert {r.student_identifier for r in rows} == {"Eric Albrecht"}
    assert (rows[3].first_name, rows[3].last_name) == ("Albrecht", "Eric")
    assert messages == [
        "Student Eric Albrecht has potential flipped first and last name Albrecht Eric in semester Spring 2019"
    ]


def test_flip_can_straighten_names(scores_of):
    rows, _ = outcome(repair_flipped(scores_of(FLIP), repair_names=True))
    assert (rows[3].first_name, rows[3].last_name) == ("Eric", "Albrecht")


def test_flip_tie_repairs_nothing(scores_of):
    before = scores_of(pairs([("Eric", "Snow", "Eric Snow", 4), ("Snow", "Eric", "Snow Eric", 4)]))
    rows, messages = outcome(repair_flipped(before))
    assert messages == [] and rows == before.orderBy("ord").collect()


def test_dash_compares_first_name_with_whole_identifier(scores_of):
    names = [("Mary", "Ann", "Mary Ann", 4)] * 3 + [("Mary-Ann", "Snow", "Mary-Ann Snow", 3),
                                                    ("Eva-Lou", "Pym", "Eva-Lou Pym", 3)]
    rows, messages = outcome(repair_dashes(scores_of(pairs(names))))
    assert [r.student_identifier for r in rows] == ["Mary Ann"] * 4 + ["Eva-Lou Pym"]
    assert (rows[3].first_name, rows[3].last_name) == ("Mary", "Ann")
    assert messages == ["Student Mary Ann has potential missing dash Mary-Ann Snow in semester Spring 2019"]


def test_dash_can_compare_identifiers(scores_of):
    names = [("Eva Lou", "Pym", "Eva Lou Pym", 4)] * 2 + [("Eva-Lou", "Pym", "Eva-Lou Pym", 3)]
    rows, messages = outcome(repair_dashes(scores_of(pairs(names)), match="identifier"))
    assert {(r.student_identifier, r.first_name) for r in rows} == {("Eva Lou Pym", "Eva Lou")}
    assert len(messages) == 1


def test_dash_prevails_over_flip_and_names_the_flipped_identifier(scores_of):
    names = (
        [("Mary", "Ann", "Mary Ann", 4)] * 3
        + [("Snow", "Mary-Ann", "Snow Mary-Ann", 4)] * 2
        + [("Mary-Ann", "Snow", "Mary-Ann Snow", 3)]
    )
    rows, messages = outcome(validate_scores(scores_of(pairs(names)), Rules(misspellings=False)))
    assert rows[5].student_identifier == "Mary Ann"
    assert messages == [
        "Student Mary Ann has potential missing dash Snow Mary-Ann in semester Spring 2019",
        "Student Snow Mary-Ann has potential flipped first and last name Mary-Ann Snow in semester Spring 2019",
    ]


STANDINGS = {  # student: values in order, the value chosen, whether it is a conflict
    "Majority": (["4 - Senior", "3 - Junior", "4 - Senior"], ["4 - Senior"] * 3, True),
    "Tie": (["3 - Junior", "4 - Senior"], ["3 - Junior"] * 2, True),
    "Late": (["b", "a", "a", "b"], ["b"] * 4, True),
    "Missing": ([None, None, "4 - Senior"], [None] * 3, True),
    "Gap": ([None, "4 - Senior"], [None] * 2, True),
    "Case": (["4 - senior", "4 - Senior", "4 - Senior"], ["4 - senior", "4 - Senior", "4 - Senior"], False),
    "Apart": (["4 - senior", "4 - Senior", "3 - Junior", "3 - Junior"], ["3 - Junior"] * 4, True),
}


def test_standing_conflicts(scores_of):
    rows = [{"first": s, "last": "Lee", "standing": v} for s, (values, _, _) in STANDINGS.items() for v in values]
    fixed, messages = outcome(resolve_standing(scores_of(rows)))
    for student, (_, chosen, _) in STANDINGS.items():
        assert [r.class_standing for r in fixed if r.first_name == student] == chosen, student
    assert messages == sorted(
        f"Student {s} Lee has multiple class standings for semester Spring 2019; picking {chosen[0] or ''}"
        for s, (_, chosen, conflict) in STANDINGS.items() if conflict
    )


def one_student(attribute, values):
    return [{"first": "Ann", "last": "Lee", attribute: v} for v in values]


def test_emphasis_conflict_is_per_semester(scores_of):
    rows = one_student("emphasis", ["Acting", "Design", "Design"])
    rows.append({"first": "Ann", "last": "Lee", "emphasis": "Acting", "semester": "Fall 2019", "sort": "20192"})
    fixed, messages = outcome(resolve_emphasis(scores_of(rows)))
    assert [r.emphasis for r in fixed] == ["Design"] * 3 + ["Acting"]
    assert messages == ["Student Ann Lee has multiple emphases for semester Spring 2019; picking Design"]


def test_misspelling_may_combine_a_new_name(scores_of):
    names = ([("Jon", "Smith")] * 2 + [("Jon", "Smyth")] * 2 + [("John", "Smyth")] * 3)
    rows, _ = outcome(validate_scores(scores_of([{"first": f, "last": l} for f, l in names])))
    # Smyth is commonest by last name, Jon by first name.
    assert {(r.first_name, r.last_name, r.student_identifier) for r in rows} == {("Jon", "Smyth", "Jon Smyth")}


def test_values_that_differ_by_a_letter_without_capital_are_a_conflict(scores_of):
    rows = [{"first": "A", "last": "B", "emphasis": e} for e in ("Maßwerk", "Masswerk", "MASSWERK", "Masswerk")]
    result = resolve_emphasis(scores_of(rows))
    assert {r.emphasis for r in result.scores.collect()} == {"Masswerk"} and result.messages.count() == 1
    same = resolve_emphasis(scores_of([{"first": "A", "last": "B", "emphasis": e} for e in ("Masswerk", "MASSWERK")]))
    assert same.messages.count() == 0
