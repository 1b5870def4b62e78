"""Writers: reports, training exports, SQL dumps, split files, pushes."""
