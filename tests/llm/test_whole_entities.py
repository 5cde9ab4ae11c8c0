"""No part of a secret or of a name stays in clear."""

import re

import pytest

from crewmetrics.llm import pii

TOKEN = "".join(f"aB{i % 10}x" for i in range(50))
JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fwpM"
SECRETS = [
    ("token={}", TOKEN), ("token: {} and more", JWT), ("GITHUB_TOKEN={}", "ghp_abcDEF123456ghi"), ("client_secret={}.", "abcDEF123456ghi"), ("aws_secret_access_key      = {}", "abc/DEF+123456=="),
    ('{{"api_key": "{}", "n": 1}}', "abcDEF123456ghi"), ("'password' => '{}'", "correct horse 7 battery"), ('\\"accessToken\\": \\"{}\\"', "abcDEF123456ghi"), ("password={}", "p4$sw0rd!with@signs"),
    ('token = "{} without an end', "abcDEF123456ghi"), ("SECRET_KEY={}", "k" + "aB3" * 1000),
]
NAMES = [
    ("Señora {} came", "Ana María García López"), ("Herr {} kam", "Ludwig van der Rohe"), ("Frau {} kam", "von Droste zu Hülshoff"), ("Mr {} is", "John F. Kennedy"), ("Dr {}.", "Abcd Efgh Ijkl Mnop Qrst Uvwx Yzab"),
    ("Dr {} end", "Word " * 1500 + "Wordy"),
]


@pytest.fixture(scope="module")
def replaced(shared):
    texts = [form.format(value) for form, value in SECRETS + NAMES] + ["the token: none here", "Mr Alan Smith met the press"]
    table = shared.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_entities) for r in pii.replace_entities(table, "key").orderBy("doc_id").collect()]


@pytest.mark.parametrize("i", range(len(SECRETS)))
def test_whole_secrets(replaced, i):
    form, value = SECRETS[i]
    text, n = replaced[i]
    before, after = form.replace("{{", "{").replace("}}", "}").split("{}")
    assert n == 1 and text.startswith(before) and text.endswith(after) and len(text) == len(before) + len(value) + len(after)
    made = text[len(before) : len(text) - len(after)]
    assert [c.isalnum() for c in made] == [c.isalnum() for c in value]
    letters = [(a, b) for a, b in zip(made, value) if b.isalnum()]
    assert sum(a == b for a, b in letters) < len(letters) / 3


@pytest.mark.parametrize("i", range(len(NAMES)))
def test_whole_names(replaced, i):
    form, value = NAMES[i]
    text, n = replaced[len(SECRETS) + i]
    before, after = form.split("{}")
    assert n == 1 and text.startswith(before) and text.endswith(after)
    assert not set(re.findall(r"\w+", value)) & set(re.findall(r"\w+", text[len(before) : len(text) - len(after)]))


def test_what_follows_a_name_stays(replaced):
    assert replaced[-2] == ("the token: none here", 0) and replaced[-1][1] == 1 and replaced[-1][0].endswith(" met the press")
