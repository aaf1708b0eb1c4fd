from trackweave.cli import main

raise SystemExit(main())
