"""Where the test tables are."""

SF_SMALL = "/root/testdata/sf0.001"
