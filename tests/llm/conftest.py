import hashlib
import random

import pytest

WORDS = "the of and river stone cloud amber light over under green field morning winter table copper silent harbour".split()


def prose(n: int, seed: int) -> str:
    draw = random.Random(seed)
    out = [draw.choice(WORDS) + draw.choice(["", "s", "ed", "ing", "ly", "ness"]) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(out))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): copies, near copies, nulls, empty, very short and very long texts, other alphabets, repeated rows."""
    rows: list[tuple] = [(i, prose(20 + 37 * (i % 13), i), f"src{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "src0") for i in range(6)]
    for i in range(12):
        words = rows[7][1].split()
        words[i * 5] = f"changed{i}"
        rows.append((200 + i, " ".join(words), None))
    rows += [(300, None, None), (301, "", "src1"), (302, "   \n\t ", "src2"), (303, "one", "src0"), (304, "two words", "src0"), (305, "two words", "src1")]
    rows += [(400, "Füße étaient là. ОДНО слово 漢字 𝒳" * 30, "src2"), (401, "x" * 3000, "src1"), (402, "ab " * 1500, "src1"), (403, prose(9000, 77), "src0")]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names the operators use inside."""
    rows = [(i, t, s, "en", len(t or ""), 1, "y") for i, t, s in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, size int, class string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
