"""A retriever in a child process that answers, refuses, dies and hangs."""
import sys
import textwrap

import pytest

from tessella.operators import child
from tessella.operators.retrievers import Retriever
from tessella.operators.runs import GuardError

SCRIPT = """
import os, sys, time
sys.path.insert(0, {root!r})
from tessella.operators.child import serve
docs = {{0: "a b", 1: "b c", 2: "c d"}}

def answer(text, k):
    if text.startswith("die"):
        flag = text.split()[1]
        if not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(3)
    if text == "hang":
        time.sleep(60)
    if text == "bad":
        raise KeyError("bad")
    hits = [(i, float(len(set(text.split()) & set(t.split())))) for i, t in docs.items()]
    return sorted((h for h in hits if h[1]), key=lambda h: (-h[1], h[0]))[:k]

serve(answer, "toy", "3:abc", list(docs.values()))
"""


@pytest.fixture
def argv(tmp_path):
    import tessella

    root = tessella.__path__[0].rsplit("/", 1)[0]
    (tmp_path / "child.py").write_text(textwrap.dedent(SCRIPT.format(root=root)))
    return [sys.executable, str(tmp_path / "child.py")]


def begun(argv, **more):
    return child.Child(lambda: child.Lines(argv), **({"arm": "toy", "corpus_id": "3:abc"} | more))


def test_protocol(argv):
    c = begun(argv)
    assert c.info == {"arm": "toy", "corpus_id": "3:abc", "n_docs": 3} and c.names() == ["a b", "b c", "c d"]
    assert c.query("b c", 2) == [(1, 2.0), (0, 1.0)] and c.query("z", 2) == []
    for bad in ({"cmd": "query", "text": "bad", "k": 1}, {"cmd": "what"}):
        with pytest.raises(ValueError, match="refuses"):
            c.request(bad)
    assert c.request({"cmd": "stats"}) == {"n_queries": 3} and (c.n_queries, c.n_returned, c.n_restarts) == (2, 2, 0)
    process = c.lines.process
    c.close()
    assert process.poll() == 0


@pytest.mark.parametrize("more", [{"arm": "other"}, {"corpus_id": "3:abd"}])
def test_another_arm_or_corpus_is_refused(argv, more):
    with pytest.raises(GuardError, match="serves"):
        begun(argv, **more)


def test_a_child_that_dies_is_started_again(argv, tmp_path):
    c = begun(argv)
    assert c.query(f"die {tmp_path / 'once'} a", 1) == [(0, 1.0)] and c.n_restarts == 1
    c.close()


def test_a_child_that_hangs_is_given_up(argv):
    c = begun(argv, seconds=0.5, restarts=1)
    with pytest.raises(child.ChildError, match="no answer"):
        c.query("hang", 1)
    assert c.n_restarts == 1 and c.lines.process.poll() is not None
    with pytest.raises(child.ChildError):
        begun([sys.executable, "-c", "print('hello')"])


def test_in_tasks(spark, argv):
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "c", None, "b d", "z"])], "qid long, text string").repartition(3)
    x = child.ChildRetriever(argv, "toy", "3:abc")
    assert isinstance(x, Retriever)
    assert sorted(tuple(r) for r in x.retrieve(queries, 2).collect()) == [(0, 0, 1.0, 1), (1, 1, 1.0, 1), (1, 2, 1.0, 2), (3, 0, 1.0, 1), (3, 1, 1.0, 2)]
    with pytest.raises(Exception, match="serves"):
        child.ChildRetriever(argv, "toy", "other").retrieve(queries).collect()
