import datetime as dt
import json

import pytest

from custvalue.__main__ import DOCUMENTS, main


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    """Fit and publish from files, by the command line."""
    folder = tmp_path_factory.mktemp("jobs")
    lines = ["CtcID,OrderDate,Source,Location,Transactional Value"]
    for customer in range(60):
        for visit in range(1 + customer % 5):
            day = dt.date(2021, 5, 1) + dt.timedelta(days=7 * customer % 300 + 13 * visit)
            place = "The Sun Inn" if customer % 3 else "Reigate"
            lines.append(f"{customer},{day} 12:00:00,Web,{place},{10 + customer + visit}")
    (folder / "tx.csv").write_text("\n".join(lines) + "\n")
    (folder / "contacts.csv").write_text(
        "CtcID,PostCode,Age,BirthDate,Age Category\n" + "".join(f"{c},,,,18-24\n" for c in range(30))
    )
    source = ["--transactions", str(folder / "tx.csv"), "--clv-model", str(folder / "clv"),
              "--forecast-model", str(folder / "forecast")]
    main(["fit", *source])
    out = str(folder / "out")
    main(["publish", *source, "--contacts", str(folder / "contacts.csv"), "--out", out,
          "--forecast-end", "2021-05-20"])
    return out


@pytest.mark.parametrize("name", DOCUMENTS)
def test_every_document_shows(reports, capsys, name):
    main(["show", name, "--reports", reports])
    assert json.loads(capsys.readouterr().out)


def test_shown_values(reports, capsys):
    def shown(*arguments):
        main(["show", *arguments, "--reports", reports])
        return json.loads(capsys.readouterr().out)

    assert shown("locations") == {"locations": ["Reigate", "The Sun Inn"]}
    assert shown("segments")["all_cus_clv"]["users"] == [40]
    assert shown("segments", "--location", "Reigate")["all_cus_clv"]["users"] == [20]
    assert len(shown("dashboard")["prediction_graph"]["prediction_val"]) == 20
    missing = shown("summary", "--year", "1999")["executive_summary"]
    assert set(missing.values()) == {"-"}
    month = shown("summary", "--start", "2021-06-01", "--end", "2021-12-31")["executive_summary"]
    assert month["orders_prev"] == "-" and month["orders_selected"] != "-"


def test_shown_documents_follow_the_published_rules(reports, capsys, tmp_path):
    source = ["--transactions", reports.replace("out", "tx.csv"), "--clv-model", reports.replace("out", "clv"),
              "--forecast-model", reports.replace("out", "forecast")]
    out = str(tmp_path / "other")
    main(["publish", *source, "--contacts", reports.replace("out", "contacts.csv"), "--out", out,
          "--unknown-age", "n/a", "--churn-factor", "1.5", "--default-year", "2022"])
    capsys.readouterr()

    def shown(*arguments, reports=out):
        main(["show", *arguments, "--reports", reports])
        return json.loads(capsys.readouterr().out)

    ages = shown("ages")
    assert ages["unknown_tot_cus"] and "n/a" not in ages["analytics_graph"]["age_category"]
    assert shown("summary") == shown("summary", "--year", "2022")
    assert shown("summary", reports=reports) == shown("summary", "--year", "2021", reports=reports)
    assert {k: v for k, v in shown("dashboard").items() if k in ages} == ages


def test_a_document_name_is_required(capsys):
    with pytest.raises(SystemExit):
        main(["show", "everything", "--reports", "x"])
    assert "invalid choice" in capsys.readouterr().err
