from echofold.cli import main

raise SystemExit(main())
