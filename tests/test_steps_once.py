"""Steps that several tables are made of are worked out once."""

from scoreloom.operators import ledgers, voices
from scoreloom.plans import fact_queries

SF = "/root/testdata/sf0.001"


def names_of(monkeypatch, *modules):
    names = []
    for module in modules:
        write = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, write=write: names.append(name) or write(df, name))
    return names


def test_voices_look_for_polyphony_once(spark, monkeypatch):
    names = names_of(monkeypatch, voices, fact_queries)
    found = fact_queries.q_voices(spark, SF)
    assert names == ["line_events", "polyphonic"]
    assert found.count() == fact_queries.line_events(spark, SF).count()


def test_ledger_chain_ends_with_its_last_step(spark, monkeypatch):
    names = names_of(monkeypatch, ledgers, fact_queries)
    fact_queries.q_ledger_ladder(spark, SF)
    assert names == ["lines", "ledgers", *["chain"] * 4]  # strokes lie on steps 1 to 4 only: the last write finds nothing
