from quernlake.cli import main

raise SystemExit(main())
