import pytest

from quality_probe.llm import queries, secrets


@pytest.mark.parametrize("text, value", [
    ("pwd: QzXkVbnWplRtyHgF end", "QzXkVbnWplRtyHgF"),
    ("passphrase = qzxkvbnwplrt", "qzxkvbnwplrt"),
    ("Authorization: Bearer QzXkVbnWplRtyHgF", "QzXkVbnWplRtyHgF"),
    ("bearer qzxkvbnwplrtyhgfmjw", "qzxkvbnwplrtyhgfmjw"),
    ("password: placeholder", None),
    ("password authentication and token internationalization", None),
    ("ein Passwort Sicherheitsüberprüfung, a secret Zugangsberechtigung", None),
])
def test_letters_are_judged_by_cost(text, value):
    found = secrets.guess_spans(text, secrets.dictionary(queries.tokenizer_path()))
    assert [text[s:e] for s, e, _ in found] == ([value] if value else [])
