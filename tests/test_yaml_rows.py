"""Proposal blocks are parsed within their rows: one shuffle, and the rules of the reference."""

from lorekit.operators.instincts import parse_yaml_blocks

TEXT = """Found:

```yaml
id: "a-1"
# note: x
  trigger :  'when: it'
action: do
action: " do more "
domain:
confidence: high
nothing here
# end
```
```yml
id: b
trigger: t
```
```yaml
id: c\r\ntrigger: t\x85action: 　a 
confidence: 0.7
evidence: "seen"
```
"""


def test_blocks(spark):
    out = parse_yaml_blocks(spark.createDataFrame([("r", TEXT), ("s", None), (None, "```yaml\nid: i\ntrigger: t\naction: a\n```")], "response_id string, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted((tuple(r) for r in out.collect()), key=str) == [
        ("r", 0, "a-1", "when: it", " do more ", None, 0.3, None), ("r", 2, "c", "t", "a", None, 0.7, "seen"), (None, 0, "i", "t", "a", None, None, None)]
    assert plan.count("Exchange hashpartitioning") == 1
