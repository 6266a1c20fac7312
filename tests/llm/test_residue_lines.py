import pytest

from graphloom.llm.residue import residue


@pytest.mark.parametrize(
    "line, kinds",
    [
        ("Dear {{first_name}} {{last_name}}", ["placeholder"]), ("Author: {{author}} | Date: {{date}}", ["placeholder"]), ("Dear ${first} ${last}", ["placeholder"]), ("Hello {% name %} of {% team %}", ["placeholder"]),
        ('The "{{title}}" was written by {{author}} in May', ["placeholder"]), ("The '{{title}}' by '{{author}}' in May", []), ("x = {{a}} + {{b}};", []), ("if (x) { call({{a}}, {{b}}) }", []), ('<div class="{{a}}" id="{{b}}">{{c}}</div>', []),
    ],
)
def test_all_placeholders_of_a_line(line, kinds):
    assert residue(line) == kinds


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("The queue is described in <project name goes here>.", ["placeholder"]), ("Dear [name], welcome aboard", ["placeholder"]), ("Hi <first name>, thanks", ["placeholder"]), ("Ask [the team](http://x) first", []), ("Service Unavailable", ["error"]), ("This page cannot be displayed", ["error"]),
        ('{"error": "bad_gateway", "status": 502, "request_id": "1"}', ["error"]), ('{"status": 200, "message": "ok"}', []), ("Text text text Text text text text text text.", ["filler"]), ("text text\n", []), ("The service unavailable to guests is listed below.", []),
        ("```\n{\"error\": \"x\", \"status\": 500}\n```", []),
    ],
)
def test_more_residue(text, kinds):
    assert residue(text) == kinds
