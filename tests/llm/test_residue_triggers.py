import pytest

from graphloom.llm import residue as R

OPEN = {"[": "]", "<": ">", "(": ")"}
LINES = {
    "placeholder": [
        "{{ a }}", "{{{ a }}}", "{% a %}", "<% a %>", "<%= a %>", "${a}", "#{a}", "[[ a ]]", "@@a@@", "%%a%%", "<<a>>", "__a_b__", "TBD - x", "Owner: TBC.", "TBD",
        *[f"Text {o}{gap}{word}{gap}:{gap}{verb} name{c}" for o, c in OPEN.items() for gap in ("", " ", "\t") for word in ("todo", "TBD", "FIXME", "f\u0130xme", "f\u0131xme") for verb in ("fill", "add", "insert", "enter", "write", "describe")],
        *[f"Text {o}{gap}{verb}{sep}name{gap if o == '<' else ''}{OPEN[o]}" for o in "[<" for gap in ("", " ") for sep in (" ", "\t") for verb in ("Insert", "enter", "ADD", "put", "fill in", "in\u017fert")],
        *[f"Text ({gap}{verb}\tname)" for gap in ("", " ") for verb in ("enter", "insert")], *[f"Text {o}\t Your\tname here {OPEN[o]}" for o in "[<"],
    ],
    "value": [
        *[f"{hello}{gap}{value} and so on" for hello in ("Hello", "Hi", "Dear", "Welcome", "Hallo", "Hola", "Estimado", "Estimada", "Liebe", "Lieber", "Guten Tag") for gap in (" ", ", ", "  ", "! ") for value in ("undefined", "null", "NaN", "None", "nil")],
        *[f"{field}:{gap}{value}" for field in ("Name", "Owner", "E-mail", "Version") for gap in ("", " ", "  ", "\t") for value in ("undefined", "null", "NaN", "None", "nil")],
        *[f"Approved by {value} on {other}." for value in ("null", "None", "nil", "undefined", "NaN") for other in ("null", "None", "nil", "undefined", "NaN")], "Total [object Object] due", "Due Invalid Date at noon",
    ],
    "filler": ["- Item\tone\n- Item\ttwo\n- bullet\u00a0three", "Duis aute irure dolor in velit esse cillum", "bar baz qux bar baz qux", "testing test abc testing test abc", "sdf lkj sdf lkj zzz blub"],
}


@pytest.mark.parametrize("kind", sorted(LINES))
def test_every_alternative_passes_the_prefilter(kind):
    assert [t for t in LINES[kind] if R.residue(t) != [kind]] == []


def test_mash_words_pass():
    assert [w for w in R._MASH if R.residue(" ".join([w] * 6)) != ["filler"]] == []


@pytest.mark.parametrize("text", ["The function returns null or None for an empty list.", "Put your name into the todo list (see below).", "Testing the foo and bar modules needs a test account.", "Enter the room, then add water.", "The item list has a bullet point."])
def test_prose_stays_prose(text):
    assert R.residue(text) == []


@pytest.mark.parametrize("pattern, strings", [(r"a(?:bc|de)f", {"bc", "de"}), (r"(?:xy)?z", {"z"}), (r"(?:x|\w)+", None), (r"(?i:FOO)\s+b", {"foo"}), (r"[ab]+", None), (r"(?:long)+s?", {"long"})])
def test_needed_strings(pattern, strings):
    assert R.needed(pattern) == (frozenset(strings) if strings else None)
