"""National ids in lists and tables, and account numbers before upper-case words."""

from mediaops.llm import personal_data


def test_lists_of_ids_and_accounts_before_words(spark):
    ids = [f"123-45-{6780 + i}" for i in range(40)]
    texts = [
        "SSN 123-45-6789, 123-45-6780, 123-45-6781", "123-45-6789 is the SSN of the man", "part 123-45-6789, 123-45-6780",
        "name,city,ssn\n" + "\n".join(f"Someone Named So,Some Long Town Name,{i}" for i in ids), "part 123-45-6789 " + "x" * 300 + " ssn 123-45-6780",
        "DE89 3704 0044 0532 0130 00 BIC COBADEFF", "IBAN GB82 WEST 1234 5698 7654 32 NEXT DE89370400440532013000 OK", "NO12 DE89 3704 0044 0532 0130 00",
        "DE89 3704 0044 0532 0130 01 BIC COBADEFF", "🎉 ssn 123-45-6789 🎉 123-45-6780"]
    found = personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {r.doc_id: [s for s in r.personal if s.kind in personal_data.KINDS[4:]] for r in found}
    assert all(texts[i][s.start:s.end] == s.value for i, some in spans.items() for s in some)
    assert {i: [s.value for s in some] for i, some in spans.items()} == {
        0: ["123-45-6789", "123-45-6780", "123-45-6781"], 1: ["123-45-6789"], 2: [], 3: ids, 4: ["123-45-6780"],
        5: ["DE89 3704 0044 0532 0130 00"], 6: ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], 7: ["DE89 3704 0044 0532 0130 00"],
        8: [], 9: ["123-45-6789", "123-45-6780"]}
