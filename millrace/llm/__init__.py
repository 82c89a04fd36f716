"""Operators for preparing training data. Nothing outside this subpackage imports it.

Common rules, which each operator's docstring refines:

* An operator reads only the columns it names, so extra columns of any name do no harm.
* A null text has no words, characters or tokens; an empty table gives an empty result
  of the same schema; a repeated row is judged like the row that it repeats.
* Scratch tables go to the shared folder in ``spark.checkpoint.dir`` (see ``store``).
"""
