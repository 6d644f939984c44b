"""Keys of forms that the training doesn't make, and what is found where there are none."""

import base64
import random
import string
import uuid

import pytest

from calorant.llm import secrets

SF = "/root/testdata/sf0.01"
LETTERS = string.ascii_letters + string.digits


def forms(rng):
    word = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    return {
        "prefixed": lambda: "ghp_" + word(LETTERS, 36), "dashed": lambda: "sk-" + word(LETTERS, 48), "numbered": lambda: f"xoxb-{word(string.digits, 12)}-{word(string.digits, 12)}-{word(LETTERS, 24)}",
        "dotted": lambda: "eyJhbGciOiJIUzI1NiJ9." + word(LETTERS, 60) + "." + word(LETTERS + "-_", 43), "mixed": lambda: "AIza" + word(LETTERS + "-_", 35), "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        "base64": lambda: base64.b64encode(bytes(rng.getrandbits(8) for _ in range(30))).decode(), "upper": lambda: word("0123456789ABCDEF", 32),
        "password": lambda: "".join(rng.sample(word(LETTERS, 10) + word("!@#$%^&*", 3) + word(string.digits, 1), 14)), "one mark": lambda: word(LETTERS, 13) + rng.choice("!@#$%") + word(LETTERS, 2),
    }


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return secrets.fit(docs), [r.text for r in docs.where("text is not null and text <> ''").select("text").collect()]


def covered(model, text, a, b):
    held = set()
    for _, i, j in model.spans(text)[1]:
        held.update(range(i, j))
    return len(held & set(range(a, b))) >= 0.8 * (b - a)


def test_recall_of_unseen_forms(learned):
    model, texts = learned
    rng = random.Random(3)
    texts = [t for t in texts if 200 <= len(t) <= 3000]
    found = {}
    for name, form in forms(rng).items():
        hits = 0
        for _ in range(60):
            text, key = rng.choice(texts), form()
            at = text.find(" ", rng.randrange(len(text) // 2)) + 1
            hits += covered(model, text[:at] + key + " " + text[at:], at, at + len(key))
        found[name] = hits / 60
    assert sum(found.values()) / len(found) >= 0.9 and min(found.values()) >= 0.75, found


def test_ordinary_texts_have_few_findings(learned):
    model, texts = learned
    said = [text[a:b] for text in texts for kind, a, b in model.spans(text)[1] if kind == "network"]
    assert len(said) <= 0.005 * len(texts), said


def test_candidates_are_short_or_marked_too():
    taken = lambda text: [text[a:b] for a, b in secrets.candidates(text, secrets.base_spans(text))]
    assert taken("Donaudampfsch Donaudampfschiff abc123def456 aB3$efghijkl short1! end!!!!!!!!!!!!!") == ["Donaudampfschiff", "abc123def456", "aB3$efghijkl"]
    assert taken("") == [] and taken("!" * 40) == []
