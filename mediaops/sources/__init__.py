"""Reading inventories, probe text and programs; the append-only ledger."""
