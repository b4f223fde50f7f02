"""Trailing fields of task lines against a reading by one pattern a family, and by hand."""

import random
import re

from foliate.operators import tasks


def plain(text):
    """Takes one field after the other off the end, each family tried by its own pattern."""
    text = text.rstrip()
    block = re.search(r" \^([a-zA-Z0-9-]+)$", text)
    if block:
        text = text[: block.start()].rstrip()
    patterns = {f: rf"[{signs}]\ufe0f?\s*({tasks.VALUES['date']})$" for f, signs in tasks.DATE_SIGNS.items()}
    patterns |= {"recurrence": rf"🔁\ufe0f?\s*({tasks.VALUES['recurrence']})$", "on_completion": r"🏁\ufe0f?\s*([a-zA-Z]+)$", "id": r"🆔\ufe0f?\s*([a-zA-Z0-9_-]+)$", "depends_on": rf"⛔\ufe0f?\s*({tasks.VALUES['depends_on']})$"}
    fields, tags = [], []
    while text:
        for family, pattern in patterns.items():
            if m := re.search(pattern, text):
                fields.insert(0, (family, m[1], m.start(), len(text)))
                break
        else:
            if m := re.search("([" + "".join(tasks.PRIORITY_SIGNS) + "])\ufe0f?$", text):
                fields.insert(0, ("priority", tasks.PRIORITY_SIGNS[m[1]], m.start(), len(text)))
            elif m := re.search(r"(?:^|(?<=\s))(#[^\s!@#$%^&*(),.?\":{}|<>]+)$", text):
                tags.insert(0, m[1])
            else:
                break
        text = text[: m.start()].rstrip()
    return text, fields, tags, block and block[1]


def test_trailing_equals_patterns():
    draw = random.Random(6)
    pieces = ["📅 2024-01-02", "📅\ufe0f2024-02-30", "⏳ 2024-1-2", "🛫2024-01-01", "🔁 every week on friday", "🔁 every day!", "🔼", "⏫\ufe0f", "🔼 x", "#tag", "#a/b", "x#no", "#", "🏁 delete", "🆔 ab-1", "⛔ a, b ,c", "⛔ a,,b", "word", "two words", "^ab-1", "(é)", "📅", "every day"]
    for _ in range(4000):
        text = draw.choice(["", " "]).join(draw.choice([" ", "  ", "\t"]) + p if draw.random() < 0.9 else p for p in draw.choices(pieces, k=draw.randrange(7)))
        assert tasks.trailing(text) == plain(text), text


def test_trailing_fields(spark):
    df = spark.createDataFrame([(1, "Pay 📅 soon 🔼 #home 📅\ufe0f 2024-01-02 🔁 every week ^b1"), (2, None), (3, "📅 2024-01-02"), (4, "a ^b c")], "id int, text string")
    got = {r.id: (r.description, [tuple(f)[:2] for f in r.fields], r.tags, r.block) for r in tasks.trailing_fields(df, "id", "text").collect()}
    assert got == {1: ("Pay 📅 soon", [("priority", "medium"), ("due", "2024-01-02"), ("recurrence", "every week")], ["#home"], "b1"), 2: ("", [], [], None), 3: ("", [("due", "2024-01-02")], [], None), 4: ("a ^b c", [], [], None)}
    assert tasks.trailing("x " * 100_000 + "🔼 " * 20_000)[0] == ("x " * 100_000).rstrip()
