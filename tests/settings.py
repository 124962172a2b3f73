"""Folders of the supplied tables that the tests read."""

SF = "/root/testdata/sf0.01"
SF_SMALL = "/root/testdata/sf0.001"
