"""Writers: masked files, reports, bundles."""
