import io

from millrace.__main__ import shell
from millrace.session import Warehouse


def test_shell_runs_statements(spark, tmp_path):
    out = io.StringIO()
    text = "shell_t := select 1 as a,\n 'x' as b;\nselect * from shell_t;\nselect nothing;\n\\t\nfrobnicate;\nhistory\nexit\nselect 2 as never;\n"
    shell(Warehouse(spark, str(tmp_path)), io.StringIO(text), 10, out)
    said = out.getvalue()
    assert "a | b" in said and "1 | x" in said and "shell_t" in said and said.count("error:") == 2 and "never" not in said
    assert "select * from shell_t" in said
