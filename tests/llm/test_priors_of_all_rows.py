import random

from scoreloom.llm import language_model as lm


def test_priors_come_from_all_training_rows(spark, monkeypatch):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(1, 9))) for _ in range(1500)] + ["one two three four five"] * 300
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5000, None)], "doc_id long, text string")
    seen, choose = [], lm.choose_priors
    monkeypatch.setattr(lm, "choose_priors", lambda levels, model: seen.append((levels, model, choose(levels, model))) or seen[-1][2])
    assert lm.score_documents(docs).count() == len(texts) + 1
    levels, model, chosen = seen[0]
    train = docs.where(~lm.held_out())
    assert levels.count() == train.count() > 1000
    # All losses again, token by token and without counting equal contexts.
    contexts, _ = model.contexts(levels.select("levels").toArrow().column(0).combine_chunks())
    assert len(contexts) == sum(len((r.text or "").split()) + 1 for r in train.collect())
    loss = {(a, b): -model.log_probabilities(contexts, (a, b), 1.0).sum() for a in lm.PRIORS for b in lm.PRIORS}
    assert abs(loss[chosen] - min(loss.values())) < 1e-6
