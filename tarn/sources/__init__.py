"""Readers and writers of the tables, and views of other tables as candidate pools."""
