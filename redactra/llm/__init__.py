"""Operators for preparing training data at corpus scale.

Ten operators, each in its own module, over DataFrames of documents,
conversations or vectors.  Nothing outside this package imports it; the
queries that apply the operators to the bundled tables are in
:mod:`redactra.llm.queries`.

Conventions shared by all of them:

* input columns are named by parameters; every other column is ignored or
  passed on, and a column named like one of the result gives way to it;
* a null text counts as the empty text, a null id is an id like any other
  (it sorts first), repeated rows are separate rows;
* an empty table gives an empty result with the documented schema.
"""
